"""Relational operators over the traceability graph."""
