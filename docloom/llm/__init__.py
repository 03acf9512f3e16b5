"""Operators for preparing training data. Nothing outside imports this."""
