"""graphloom functions."""
