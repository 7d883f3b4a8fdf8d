"""Operators for large text corpora: deduplication, privacy, mixing, language, licences, pieces, archives."""
