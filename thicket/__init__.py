"""Knowledge-graph building and hybrid retrieval as Spark DataFrame jobs."""
