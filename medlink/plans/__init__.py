"""Whole pipelines assembled from operators."""
