"""Structured Streaming sources, sinks, state and scoring."""
