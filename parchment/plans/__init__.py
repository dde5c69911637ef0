"""Queries over the project's tables, with the SQL that checks them."""
