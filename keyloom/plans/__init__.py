"""Queries over the star-schema and document tables, each with its SQL."""
