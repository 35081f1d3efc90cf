"""tickvet: a Spark-native audit engine for market data, with a training-data toolkit beside it."""
