"""Adapter views over the input tables and the registered query catalog."""
