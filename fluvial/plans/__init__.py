"""Plans of the study-document engine."""
