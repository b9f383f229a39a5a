"""Registered queries: bindings of the operators to the driver's tables, with their oracle SQL."""
