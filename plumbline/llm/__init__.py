"""Training-data operators: cleaning, deduplication, packing, archives and sharding.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
