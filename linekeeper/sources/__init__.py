"""Readers and writers of timed text and evidence."""
