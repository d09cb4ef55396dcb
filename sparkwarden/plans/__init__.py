"""Whole plans: index build and storage, scoring, and the query catalogue."""
