"""Operators of a training-data pipeline: encoding, filtering, deduplication and scoring of documents."""
