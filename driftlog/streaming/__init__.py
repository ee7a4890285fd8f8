"""streaming of driftlog."""
