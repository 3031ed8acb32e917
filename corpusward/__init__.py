"""Spark jobs that audit large corpora of metadata documents and the tables they describe."""
