"""Operators over DataFrames of cells, lanes, requests and paths."""
