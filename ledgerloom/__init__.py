"""Tick, position-state and replay analytics as Spark DataFrame operators."""
