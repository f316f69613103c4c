"""Parallel-corpus mining on Spark: web text, dictionaries, vectors, alignment, evaluation."""
