"""Functions of the study-document engine."""
