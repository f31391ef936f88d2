"""Spark jobs that audit a lake of source projects."""
