"""Scans and sinks: landed JSON pages, the raw store, reports, star-schema tables."""
