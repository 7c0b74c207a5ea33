"""Queries on the test tables, each with its SQL twin where SQL can say the same."""
