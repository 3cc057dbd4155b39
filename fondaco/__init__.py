"""fondaco: Spark-native analytics over collections of documents and the evidence drawn from them."""

__version__ = "0.1.0"
