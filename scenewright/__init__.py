"""Scene-atlas analytics and training-data operators written as Spark jobs."""
