"""Sources of the study-document engine."""
