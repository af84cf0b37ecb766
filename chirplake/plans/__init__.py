"""Chirplake plans."""
