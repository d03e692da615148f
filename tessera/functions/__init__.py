"""Tessera."""
