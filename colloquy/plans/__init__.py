"""Registered queries on the driver's tables, with the SQL that each is held against."""
