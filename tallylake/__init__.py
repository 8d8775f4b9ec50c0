"""Evaluation-run analytics and corpus operators as Spark jobs."""
