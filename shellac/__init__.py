"""Spark jobs for curating a large catalogue, and for preparing training corpora."""
