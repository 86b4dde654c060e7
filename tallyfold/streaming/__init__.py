"""Resumable and file-driven work."""
