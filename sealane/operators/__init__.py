"""Operators on positions, routes and detections."""
