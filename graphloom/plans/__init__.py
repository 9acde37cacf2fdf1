"""Registered queries of the core, each with its SQL where SQL can express it."""
