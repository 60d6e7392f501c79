"""Keyed, versioned data on Spark: change-log replay, queries, conditional writes, digests."""
