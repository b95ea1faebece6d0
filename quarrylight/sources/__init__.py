"""Readers and writers of the corpus and of the artifacts."""
