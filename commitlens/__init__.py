"""Software-engineering metrics over version-control history, as Spark jobs."""
