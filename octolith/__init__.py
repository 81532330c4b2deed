"""Octree analytics over large point sets, expressed as Spark DataFrames."""
