"""Queries over the tables of the driver: each applies an operator to whole tables and has an SQL twin where there is one."""
