"""Plumbline: functions."""
