"""Readers, sinks and the partitioned document store."""
