"""lumenloom: Spark-native curation and analysis of large text-prompt corpora."""

__version__ = "0.1.0"
