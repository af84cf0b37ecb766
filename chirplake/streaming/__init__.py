"""Chirplake streaming."""
