"""Operators of a training-data pipeline: scoring, near-duplicate detection, decontamination, tokens and archives."""
