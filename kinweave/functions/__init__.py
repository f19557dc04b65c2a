"""Kinweave: functions over Columns."""
