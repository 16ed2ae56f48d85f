"""Spark operators for the data of AI-assisted chat accounts."""
