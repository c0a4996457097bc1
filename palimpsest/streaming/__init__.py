"""Streams: the stateless cleaning of arriving documents and windowed counts of what rules find."""
