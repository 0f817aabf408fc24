"""Operators for large-scale training-data preparation; nothing else in rankspark imports this."""
