"""Structured Streaming forms of the operators with online meaning."""
