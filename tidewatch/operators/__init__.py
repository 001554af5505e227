"""Operators over bounded event tables."""
