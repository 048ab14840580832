"""Training-data operators: secrets, near duplicates, packing, PII, toxicity, leaks, shards.

Nothing else in the library imports this subpackage.
"""
