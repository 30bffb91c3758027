"""Feeds of every trigger family in one event envelope."""
