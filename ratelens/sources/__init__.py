"""Sources of the rating-study library."""
