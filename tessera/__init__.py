"""tessera: evidence-first profiling and training-data preparation on Spark."""
