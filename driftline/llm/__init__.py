"""Operators for preparing training text: mixing, sharding, deduplication,
filtering, scoring and token output.  Nothing outside this folder (and
``corpus_pipeline.py``) imports it."""
