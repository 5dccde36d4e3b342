"""Transaction-monitoring analytics expressed as Spark DataFrame programs."""
