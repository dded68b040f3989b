"""evenkeel: Spark-native profiling, oversampling, data-quality and evaluation operators."""
