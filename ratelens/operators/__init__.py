"""Operators of the rating-study library."""
