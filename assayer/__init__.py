"""Detector evaluation and evidence decisions as Spark jobs."""
