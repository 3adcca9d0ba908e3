"""Whole jobs built from the operators, and the registered check queries."""
