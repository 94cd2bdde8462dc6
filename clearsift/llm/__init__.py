"""Operators for preparing training data: ten methods and their queries."""
