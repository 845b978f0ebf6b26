"""Training-data operators: extraction, dedup, tokenizing, packing, search, filtering.

Nothing outside this subpackage imports it.
"""
