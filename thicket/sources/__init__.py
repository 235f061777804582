"""Readers of what package registries publish."""
