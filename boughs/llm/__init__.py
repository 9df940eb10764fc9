"""Operators for building training corpora: quality, deduplication, decontamination, mixing, scoring, formats."""
