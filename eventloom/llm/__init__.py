"""Training-data operators: url rules, deduplication, quality, tokens, packing, shards.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
