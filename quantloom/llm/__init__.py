"""Training-data operators: fingerprints, deduplication, PII, sharding, archives, toxicity, packing.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
