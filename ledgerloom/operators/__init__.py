"""Table operators: DataFrame in, DataFrame out, nothing run until an action."""
