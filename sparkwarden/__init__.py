"""A PySpark-native engine for transaction fraud scoring.

JSON transactions become fixed feature vectors by DataFrame expressions, the
exact nearest labelled vectors are found by joins or an Arrow kernel, and a
score and decision follow; in batch and in Structured Streaming.
"""
