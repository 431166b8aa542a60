"""Spark-native analytics over evidence graphs: typed nodes, provenance-carrying
edges, source ranges and text bodies as DataFrames."""
