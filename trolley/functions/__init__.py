"""Recommender models: one interface over the operators."""
