"""millrace: data operators written as plain PySpark DataFrame, SQL and streaming code."""
