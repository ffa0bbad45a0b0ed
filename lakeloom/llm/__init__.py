"""Operators of a training-data pipeline: sharding, near-duplicates, language, quality,
tokens, toxicity, language-model scores, secrets, decontamination and line dedup.

Nothing else in the library imports this subpackage.
"""
