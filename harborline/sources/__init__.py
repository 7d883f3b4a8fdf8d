"""Readers, loaders, sinks and the domain views."""
