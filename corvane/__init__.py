"""Corvane: a Spark-first engine for retrieval, graph, contract and journal analytics."""

__version__ = "0.1.0"
