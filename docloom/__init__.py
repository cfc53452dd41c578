"""docloom: build and search document corpora as Spark jobs."""
