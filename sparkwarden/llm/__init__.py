"""Operators for preparing language-model training data.

Nothing else in :mod:`sparkwarden` imports this subpackage; the driver entry
file adds its queries only where it can be imported.
"""
