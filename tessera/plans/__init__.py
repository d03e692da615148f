"""Shared plan building blocks."""
