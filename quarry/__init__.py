"""quarry: code-graph analytics and corpus preparation as Spark DataFrame programs."""
