"""Scalar expressions as Column functions."""
