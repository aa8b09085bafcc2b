"""Structured streams over the same operators."""
