"""Operators for large training-data pipelines; nothing else in driftlog imports them."""
