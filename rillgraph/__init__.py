"""rillgraph: a PySpark-native graph and data-flow analytics engine.

Programs, call graphs, value-flow graphs and report histories are typed node
and edge relations in DataFrames; questions about them are Spark plans.
"""

__version__ = "0.1.0"
