"""Policies: which rules run and what their findings mean."""
