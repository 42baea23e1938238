"""Market-sentiment analytics over tables and streams, written as Spark DataFrame jobs."""
