"""Analytics of rating studies on Spark."""
