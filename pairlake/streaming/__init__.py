"""Incremental derivation."""
