"""Training-data operators: sharding, decontamination, near-dedup, tokenising, media, models.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
