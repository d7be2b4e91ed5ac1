"""lexigauge: Spark-native analytics over subword tokenizers and text corpora."""

__version__ = "0.1.0"
