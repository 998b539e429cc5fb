"""Subpackage plans of threadloom."""
