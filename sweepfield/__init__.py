"""Spark-native analytics for lidar sessions: clouds, poses, maps and rasters."""

__version__ = "0.1.0"
