"""Readers: everything becomes a DataFrame with an explicit schema."""
