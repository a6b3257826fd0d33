"""Operators of a training-data pipeline: filters, near-duplicate removal, decontamination, encoding."""
