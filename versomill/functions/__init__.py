"""Part of the segment engine."""
