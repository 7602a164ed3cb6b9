"""Whole plans: the registered queries."""
