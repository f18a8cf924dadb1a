"""Activity analytics and corpus operators written on PySpark."""
