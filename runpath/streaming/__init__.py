"""Streams: file intake and session state."""
