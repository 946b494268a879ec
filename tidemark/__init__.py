"""Point-in-time analytics operators written as plain Spark DataFrame functions."""
