"""Training-data operators: extraction, filtering, deduplication, scoring, mixing and packing.

Nothing else in the library imports this package.
"""
