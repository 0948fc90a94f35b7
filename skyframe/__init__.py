"""Spark-native analytics over satellite catalogues: feeds, canonical elements,
propagation, close-approach screening, episodes, trajectories and operations."""

__version__ = "0.1.0"
