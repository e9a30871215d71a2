"""Composed query plans over the driver tables, and their registry."""
