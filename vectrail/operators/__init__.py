"""Search, index and aggregation operators."""
