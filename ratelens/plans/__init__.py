"""Plans of the rating-study library."""
