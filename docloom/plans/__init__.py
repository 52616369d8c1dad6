"""Registered queries, each with the SQL that it is held against."""
