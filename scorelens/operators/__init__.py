"""scorelens.operators."""
