"""Readers, writers and keyed tables."""
