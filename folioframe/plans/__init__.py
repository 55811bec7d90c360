"""Inputs derived from the driver's tables, and the queries over them."""
