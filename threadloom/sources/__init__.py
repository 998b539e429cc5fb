"""Subpackage sources of threadloom."""
