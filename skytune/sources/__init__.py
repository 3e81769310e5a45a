"""Readers, fixture views, keyed cache and sinks."""
