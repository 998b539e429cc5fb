"""Subpackage streaming of threadloom."""
