"""Spark engine for resolving, validating and auditing fields read from documents."""
