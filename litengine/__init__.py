"""litengine: retrieval and corpus analytics on PySpark DataFrames."""
