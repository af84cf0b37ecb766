"""Chirplake: recognising short sounds and preparing training text on Spark."""
