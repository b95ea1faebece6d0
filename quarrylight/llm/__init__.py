"""Training-data operators: filtering, dedup, scanning, search, tokenizing and packing.

Nothing else in the library imports this subpackage.
"""
