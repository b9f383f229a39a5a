"""Operators: DataFrame to DataFrame, no I/O."""
