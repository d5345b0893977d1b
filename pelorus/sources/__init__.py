"""Readers and writers of lanes, waypoints, rasters and paths."""
