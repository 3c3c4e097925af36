"""Operators of the study-document engine."""
