"""Readers and writers for variant and sequence files."""
