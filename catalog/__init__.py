"""Registered queries with the SQL each one is checked against."""
