"""graphloom: a PySpark-native analytics engine for code graphs, events and the texts around them."""

__version__ = "0.1.0"
