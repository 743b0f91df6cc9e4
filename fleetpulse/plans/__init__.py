"""Derived inputs and end-to-end views."""
