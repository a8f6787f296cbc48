"""Analytics over property graphs of software, on Spark."""
