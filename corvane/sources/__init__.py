"""Readers with fixed schemas, extraction from files, and the writers that publish last."""
