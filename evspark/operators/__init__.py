"""Sensors, routing and per-sensor state."""
