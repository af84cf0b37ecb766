"""Chirplake sources."""
