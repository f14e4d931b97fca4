"""Plumbline: operators."""
