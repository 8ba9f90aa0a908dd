"""Sequence, structure and text corpus analytics expressed as Spark jobs."""
