"""Whole jobs: partitioning loops, core extraction, per-part training, alignment."""
