"""plans of driftlog."""
