"""Readers, writers and the small reference dimensions."""
