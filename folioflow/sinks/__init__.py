"""Sinks: drawing commands by page, whole documents as PDF bytes, and all-or-nothing saving."""
