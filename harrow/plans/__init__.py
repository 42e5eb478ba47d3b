"""Whole pipelines, as compositions of the operators."""
