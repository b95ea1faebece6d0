"""Whole flows (ask, ingest, evaluate) and the query catalogue."""
