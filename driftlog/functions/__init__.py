"""functions of driftlog."""
