"""Analytics for many shops at once, declared with Spark's DataFrame API."""
