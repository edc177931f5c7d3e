"""Analytics over daily observations of a changing station network, on Spark."""
