"""pageloom: turn a corpus of raw web pages into import-ready content with Spark."""

__version__ = "0.1.0"
