"""Queries over the library's operators and the SQL that states the same."""
