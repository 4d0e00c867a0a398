"""Training-data operators: PII, sharding, packing, near-dedup, token counts, exact-substring
dedup, toxicity, secret scans, nearest neighbours and benchmark decontamination.

Nothing else in the library imports this subpackage.
"""
