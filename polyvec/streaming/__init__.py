"""Micro-batch ingestion and deletion."""
