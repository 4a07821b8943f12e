"""Derived inputs, registered queries and their oracle SQL."""
