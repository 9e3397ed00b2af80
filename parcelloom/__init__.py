"""Districting analytics over planar unit maps, on Spark DataFrames."""
