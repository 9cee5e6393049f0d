"""Training-data operators: dedup, sharding, quality, packing, tokens,
fingerprints, personal data, URL lists and web archives.

Nothing outside this package imports it; ``corpus_pipeline.py`` at the
repository top belongs to it. Query registration is in ``registered.py``.
"""
