"""Training-data operators: sharding, mixing, extraction, deduplication, scoring.

Nothing outside this package imports it; it may be removed as a whole.
"""
