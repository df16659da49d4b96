"""Operators of a training-data pipeline: mixing, near-duplicates, sharding, archives,
neighbour search, language-model scores, personal data, tokens and toxicity.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
