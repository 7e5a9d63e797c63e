"""Queries over the driver tables."""

from fieldspark.plans import fields, inversion, io_queries, lifecycle, patterns  # noqa: F401
