"""Readers and writers: run records, the incident log, raw snapshots, knowledge files."""
