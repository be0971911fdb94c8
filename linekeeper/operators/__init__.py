"""Ordered-sequence operators over song-keyed tables."""
