"""Readers and record mappers."""
