"""Training-data operators: packing, archives, tokenizers, deduplication, scoring and search.

Nothing outside this subpackage (and corpus_pipeline.py beside it) imports it.
"""
