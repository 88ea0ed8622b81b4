"""Incremental runs: each stage applied to newly arrived inputs only."""
