"""Databases of collections, and the registered queries."""
