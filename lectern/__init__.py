"""Document-corpus analytics on Spark: files and tables of text as measured, structured, queryable corpora."""
