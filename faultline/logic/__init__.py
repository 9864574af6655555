"""Separation-logic kernel in plain Python: parse, decide within a bounded fragment, else answer unknown."""
