"""grove: Spark-first analytics for rooted trees and forests stored as tables."""

__version__ = "0.1.0"
