"""Tessera: contextual-memory analytics expressed as Spark DataFrame plans."""
