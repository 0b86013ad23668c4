"""Readers, source classification and export sinks."""
