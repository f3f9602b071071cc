"""Operators for preparing training text: search, mixing, scans, dedup, shards, tokens, archives."""
