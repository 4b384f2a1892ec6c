"""siftloom: curation and evaluation of language-model training data on Spark."""

__version__ = "0.1.0"
