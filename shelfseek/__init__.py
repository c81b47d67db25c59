"""Product-catalogue search and similarity as Spark jobs."""
