"""Registered queries and whole-study jobs built from the operators."""
