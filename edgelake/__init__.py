"""Quantitative signal research on daily market bars, as Spark jobs."""
