"""scorelens.functions."""
