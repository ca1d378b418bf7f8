"""Query catalogue: named queries and their SQL."""
