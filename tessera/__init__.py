"""Spark jobs for building, judging and reviewing retrieval and answer data."""
