"""Scalar and distribution functions."""
