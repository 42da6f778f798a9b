"""Operators that prepare and clean text and records for model training."""
