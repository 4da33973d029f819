"""Operators for training-data pipelines: packing, near duplicates, secrets, language, archives, quality, mixing, HTML, search."""
