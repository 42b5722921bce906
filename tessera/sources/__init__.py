"""Scans: files, diffs, diagnostics, traces, benchmark records."""
