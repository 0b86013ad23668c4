"""Derived tables: facts, dimensions, views, reports and catalogs."""
