"""Product-feedback triage as plain Spark DataFrame functions."""
