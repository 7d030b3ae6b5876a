"""Whole queries: the composed workflows, the test mappings and the registered queries."""
