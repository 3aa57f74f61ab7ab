"""Operators for training-data pipelines: near-duplicates, decontamination, quality, privacy, packing and token files."""
