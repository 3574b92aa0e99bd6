"""Scholia: study-material analytics as Spark DataFrame jobs."""
