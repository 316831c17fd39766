"""Registered queries over the shared test tables, with independent SQL."""
