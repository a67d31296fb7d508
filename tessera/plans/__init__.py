"""Statements, the catalog with its changes, and materialised views."""
