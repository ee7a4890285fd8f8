"""operators of driftlog."""
