"""Event-centred analytics over gridded fields, written as Spark DataFrame jobs."""
