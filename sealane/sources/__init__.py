"""Readers that give canonical columns."""
