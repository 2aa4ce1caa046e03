"""Functions of the rating-study library."""
