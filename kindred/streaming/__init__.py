"""Recommendation over streams of session requests."""
