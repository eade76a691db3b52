"""kinweave: record linkage and corpus processing as Spark DataFrame plans."""
