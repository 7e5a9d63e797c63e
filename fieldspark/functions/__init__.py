"""fieldspark.functions."""
