"""Spatial gene programs and corpus preparation as Spark jobs."""
