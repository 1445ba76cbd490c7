"""folioflow: document text extraction and task analytics on Spark DataFrames."""
