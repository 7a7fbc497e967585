"""Spark-native analytics for places, tracks, road graphs, rasters and edited collections."""
