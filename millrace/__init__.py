"""millrace: Spark-first analytics and learning operators over DataFrames."""
