"""Ordered and idempotent mutation streams."""
