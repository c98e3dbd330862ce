"""tracewell: a Spark-native analytics engine over source code, documentation and git history."""

__version__ = "0.1.0"
