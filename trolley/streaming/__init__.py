"""Incremental maintenance of the user-item table."""
