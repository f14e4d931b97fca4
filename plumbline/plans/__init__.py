"""Plumbline: plans."""
