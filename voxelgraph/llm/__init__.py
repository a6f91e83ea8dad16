"""Operators for preparing training text: filtering, deduplication, mixing and packing. Nothing else in the library imports this."""
