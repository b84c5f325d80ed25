"""Retrieval operators: scoring, quantisation, indexing, search, fusion, maintenance, ranking."""
