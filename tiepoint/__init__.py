"""Point-layer matching and merging on Spark."""
