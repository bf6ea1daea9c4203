"""Strandline: content-intelligence analytics expressed as Spark DataFrame jobs."""
