"""Readers and writers.  Malformed input is split off with a reason, never raised."""
