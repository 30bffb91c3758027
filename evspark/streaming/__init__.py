"""Streaming forms: idle detection, per-sensor state, registry table and sinks."""
