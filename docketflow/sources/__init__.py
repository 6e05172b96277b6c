"""Readers and writers: feeds, search pages, CSV, corpora, versioned tables."""
