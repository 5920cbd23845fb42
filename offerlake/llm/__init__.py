"""Training-data operators: filters, near-duplicate joins, tokenizers, fingerprints.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries
only when it is present.
"""
