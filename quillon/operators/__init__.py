"""Relational, statistical and graph operators."""
