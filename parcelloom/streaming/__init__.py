"""Streams of plan changes."""
