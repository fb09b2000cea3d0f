"""Training-data operators: filters, near-duplicates, tokens, packing, shards.

Nothing outside this subpackage imports it.
"""
