"""Plumbline: sources."""
