"""Queries of the engine on the test tables, and the SQL that gives the same results."""
