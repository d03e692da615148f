"""Stateful forms of the operators for Structured Streaming; each gives what its batch form gives."""
