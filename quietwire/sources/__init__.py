"""Typed tables in, decisions and reports out."""
