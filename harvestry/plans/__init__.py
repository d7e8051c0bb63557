"""Refresh plans computed as tables."""
