"""The resampling, de-duplication and frozen-sensor operators on unbounded input."""
