"""barloom: bar, signal and strategy analytics expressed as Spark DataFrame jobs."""
