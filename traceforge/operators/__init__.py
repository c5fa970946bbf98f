"""Operators: DataFrame in, DataFrame out, over all tests, channels and campaigns at once."""
