"""Schemas, readers and writers, parameter documents and the weather contract."""
