"""Annotated-corpus analytics on Spark."""
