"""Operators over DataFrames: corpus, vertices, edges, graphs, retrieval, evaluation, profiles."""
