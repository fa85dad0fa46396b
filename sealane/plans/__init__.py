"""Whole plans, configuration, outputs and the registered queries."""
