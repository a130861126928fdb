"""Operators on text for training data and cache hygiene. Nothing outside this package imports it."""
