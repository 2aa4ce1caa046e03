"""Streaming of the rating-study library."""
