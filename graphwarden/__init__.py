"""Checking and repair of graph-shaped data as set-based Spark plans."""
