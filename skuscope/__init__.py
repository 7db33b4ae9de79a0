"""Batch jobs on Spark that match image embeddings to a product catalog."""
