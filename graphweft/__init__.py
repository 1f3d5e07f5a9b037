"""Graphweft: link prediction and node classification over labelled multigraphs, as Spark plans."""
