"""Provenance and integrity analytics for media document corpora, on PySpark."""
