"""Reusable distributed operators: range joins, closures, sessions, ordinals."""
