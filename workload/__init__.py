"""Registered queries over the supplied tables, with the SQL they are checked against."""
