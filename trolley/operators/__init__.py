"""Operators on transactions, item graphs and baskets."""
