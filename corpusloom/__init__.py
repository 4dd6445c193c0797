"""Spark-first engine for a knowledge corpus: pages, chunks, links, entities, turns and events."""

__version__ = "0.1.0"
