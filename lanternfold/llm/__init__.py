"""Operators for preparing training corpora: filtering, near duplicates, decontamination, tokenising, sharding."""
