"""graphloom: property-graph analytics and graph data preparation on PySpark."""

__version__ = "0.1.0"
