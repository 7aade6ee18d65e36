"""Sinks: table writers and the layered output layout."""
