"""Training-data operators on Spark: formatting, packing, dedup, filters, PII, models.

Nothing outside this subpackage imports it; the repository works without it.
"""
