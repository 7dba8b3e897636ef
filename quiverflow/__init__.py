"""quiverflow: a property-graph traversal engine on PySpark DataFrames."""
