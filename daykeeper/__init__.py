"""Auditing of day-partitioned, multi-replica data archives as Spark jobs."""
