"""Whole queries: the registry of the entry file, with the SQL that gives the same rows."""
