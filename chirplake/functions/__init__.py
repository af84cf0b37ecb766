"""Chirplake functions."""
