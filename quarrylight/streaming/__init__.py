"""Stateful, time-based operators for batches and streams."""
