"""Compositions of operators: dashboard, scheduled tick and the registered queries."""
