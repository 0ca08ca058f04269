"""Registered queries: the operators over the driver's tables, and their SQL."""
