"""Job-market analytics expressed as Spark DataFrame jobs."""
