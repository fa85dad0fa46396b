"""Micro-batch and continuous forms."""
