"""Training-data operators: mixing, sharding, deduplication, packing, labelling.

Nothing outside this package imports it; the package itself imports nothing
from the rest of the library, so either part can be removed alone.
"""
