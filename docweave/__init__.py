"""Incremental ingest of nested documents, expressed as Spark DataFrame operators."""
