"""corpusloom: document-corpus building, retrieval and wiki search as Spark jobs."""
