"""Reachability, scheduling and build-performance analytics on Spark DataFrames."""
