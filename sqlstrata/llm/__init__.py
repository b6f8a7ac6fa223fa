"""Operators of a training-data pipeline: tokenized output, toxicity, archive
conversion, language evidence, exact search, similarity joins, packing,
near-duplicate vectors, source mixing, repeated passages, conversation prefixes,
filter audits and personal data.

Nothing else in the library imports this subpackage.
"""
