"""Readers and writers of records, scores and reports."""
