"""Queries and the SQL that must agree with them."""
