"""Plumbline: streaming."""
