"""Readers of trade reports, quote files and manifests, and their writers."""
