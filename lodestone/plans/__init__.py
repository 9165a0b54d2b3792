"""Registered queries: library operators bound to the shared test tables, with their SQL."""
