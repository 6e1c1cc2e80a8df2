"""Document analytics on PySpark: retrieval, grounding, memory and corpus operators as DataFrames."""
