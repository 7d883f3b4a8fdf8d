"""Structured Streaming sources, sinks and stateful operators."""
