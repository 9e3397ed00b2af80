"""Operators over unit tables, edges and plans."""
