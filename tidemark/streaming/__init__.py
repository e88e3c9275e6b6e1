"""Operators over unbounded input: the state of each series is kept between batches."""
