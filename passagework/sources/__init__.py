"""Reading, writing and scratch space for the tables."""
