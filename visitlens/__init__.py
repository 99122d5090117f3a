"""Visitor analytics and corpus processing as Spark jobs."""
