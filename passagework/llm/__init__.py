"""Training-data operators: dedup, filters, secrets, tokens and archive checks."""
