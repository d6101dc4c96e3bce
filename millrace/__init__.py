"""millrace: rule books, document operators and review operations as Spark DataFrames."""
