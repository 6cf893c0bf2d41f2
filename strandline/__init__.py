"""strandline: time-series, strategy-verification and training-data operators as Spark jobs."""
