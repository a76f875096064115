"""tabwright: tabular analytics and model building as plain Spark DataFrame jobs."""
