"""quillspark: hybrid retrieval, task-graph analytics and corpus processing as Spark plans."""
