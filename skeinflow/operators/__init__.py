"""Relational, bag, pair and key-value operators, each a composition of DataFrame operations."""
