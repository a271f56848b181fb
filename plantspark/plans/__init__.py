"""Reusable plan shapes: ordered work split into time slices, exact quantiles, null-safe joins."""
