"""Subpackage functions of threadloom."""
