"""Reading, writing and looking at tables."""
