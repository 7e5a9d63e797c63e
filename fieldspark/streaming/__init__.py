"""fieldspark.streaming."""
