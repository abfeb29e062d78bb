"""Document analytics on Spark: word-processing semantics as DataFrame operators."""
