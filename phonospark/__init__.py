"""Phonological feature analytics and corpus operators, expressed as Spark jobs."""
