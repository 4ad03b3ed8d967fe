"""scorelens.sources."""
