"""sources of driftlog."""
