"""Bulk analytics over a keyed, multi-typed, versioned key space and its ordered command log, on Spark."""
