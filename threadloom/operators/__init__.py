"""Subpackage operators of threadloom."""
