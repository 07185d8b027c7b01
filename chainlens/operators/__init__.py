"""Operators grouped by the table they work on."""
