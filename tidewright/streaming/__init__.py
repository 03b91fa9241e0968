"""Change feeds, overlays and incrementally maintained queries."""
