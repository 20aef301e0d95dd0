"""Scoring of answers as they arrive."""
