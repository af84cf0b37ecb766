"""Chirplake operators."""
