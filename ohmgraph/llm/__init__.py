"""Operators for preparing training data: dedup, classification, packing, mixing, search and extraction.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
