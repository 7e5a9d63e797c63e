"""fieldspark.operators."""
