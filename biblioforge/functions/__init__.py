"""Subpackage of biblioforge."""
