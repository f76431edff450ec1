"""Registered plans; importing any of them loads all, in the order that they need each other."""

from . import registry  # noqa: F401
