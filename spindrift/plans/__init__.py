"""Requests, the catalog and the registered queries."""
