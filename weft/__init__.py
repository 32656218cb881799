"""weft: a Spark-native subword corpus engine."""
