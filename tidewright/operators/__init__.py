"""Ordering and pages, and the algebra of bags with signed multiplicities."""
