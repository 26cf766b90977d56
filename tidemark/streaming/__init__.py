"""Streaming forms: event-time windows, draining a result, and the ordered operators with state."""
