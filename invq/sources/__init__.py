"""Schemas and readers for landed snapshots, and writers for results."""
