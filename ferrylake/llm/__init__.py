"""Operators of a training-data pipeline (dedup, decontamination, extraction,
PII, packing, quality, URL filters, WARC revisits, shards, LM scores).

Nothing else in the library imports this subpackage.
"""
