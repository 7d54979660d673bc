"""Classifier training and scoring as Spark jobs."""
