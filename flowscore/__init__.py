"""Classify event and network-flow records with Spark, in batch and streaming."""
