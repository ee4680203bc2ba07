"""Streams of files with keyed state."""
