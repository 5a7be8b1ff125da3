"""Company discovery and entity resolution as Spark DataFrame operators."""
