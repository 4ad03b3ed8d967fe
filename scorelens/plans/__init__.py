"""scorelens.plans."""
