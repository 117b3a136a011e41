"""Readers.  All are lazy; a schema is given, never guessed from a sample."""
