"""Operators of a training-data pipeline (quality, near-duplicates, PII, mixing, packing ...).

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
