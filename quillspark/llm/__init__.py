"""Operators of a training-data pipeline: tokenising, counting, filtering, deduplicating, mixing, sharding, extracting.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. ``registry`` lists its queries.
"""
