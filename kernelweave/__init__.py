"""Spark-first analytics kernels: graphs, points, grids, signals and text as DataFrames."""
