"""Incremental forms of the disclosure flow."""
