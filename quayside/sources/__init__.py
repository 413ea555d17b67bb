"""Readers, writers and the sales panel."""
