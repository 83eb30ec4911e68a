"""Operators for preparing large text corpora: quality, dedup, decontamination, privacy, packing."""
