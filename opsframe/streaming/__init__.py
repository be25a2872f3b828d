"""Structured Streaming operators over status, checkpoint, metric and alarm feeds."""
