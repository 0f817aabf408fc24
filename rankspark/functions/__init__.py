"""Part of rankspark."""
