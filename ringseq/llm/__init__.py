"""Training-data operators on DataFrames: quality, mixing, archives, sharding, extraction, media, deduplication, chat and packing.

Nothing else in the library imports this package.
"""
