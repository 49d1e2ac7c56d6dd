"""tideboard: job-posting analytics as Spark DataFrame transformations."""
