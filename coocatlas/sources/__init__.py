"""Readers, sinks and the staging folder."""
