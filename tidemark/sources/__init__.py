"""Readers, the partitioned lake, and the small state tables around it."""
