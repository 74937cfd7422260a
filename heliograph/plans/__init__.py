"""Queries over the tables, each with the SQL that gives the same rows."""
