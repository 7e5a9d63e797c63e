"""fieldspark.sources."""
