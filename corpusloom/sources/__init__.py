"""Readers, derived tables and writers."""
