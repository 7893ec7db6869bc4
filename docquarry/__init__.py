"""Analytics over corpora of typed, inheriting, cross-referencing documents on Spark."""
