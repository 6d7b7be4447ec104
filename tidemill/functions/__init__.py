"""Column functions: rounding, statistics, hashing, text, addresses and days."""
