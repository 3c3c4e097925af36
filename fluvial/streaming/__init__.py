"""Streaming of the study-document engine."""
