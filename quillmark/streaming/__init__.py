"""Streaming form of the outcome log."""
