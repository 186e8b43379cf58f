"""Registered queries of the interval operators."""
