"""Analytics on company filing and market panels as lazy Spark DataFrame jobs."""
