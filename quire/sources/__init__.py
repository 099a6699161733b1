"""Scans and sinks: lake, raw documents, sidecars, filing indexes, queue listings."""
