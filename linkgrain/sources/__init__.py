"""Readers, and views of tables as a traceability graph."""
