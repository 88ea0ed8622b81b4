"""Relational, sequence, statistical and matrix operators."""
