"""Operators: parsing, features, index, neighbours, decision, evaluation."""
