"""Readers, writers and the schemas they share."""
