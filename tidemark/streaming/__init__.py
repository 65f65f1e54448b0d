"""Streams over commit logs and events. The embedded dialect has none; these follow from the log and from Spark."""
