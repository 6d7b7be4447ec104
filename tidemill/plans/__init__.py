"""Query catalogue: queries over the driver tables and their SQL."""
