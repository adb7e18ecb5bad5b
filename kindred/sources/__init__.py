"""Readers of interaction tables and the stores for prepared data and models."""
