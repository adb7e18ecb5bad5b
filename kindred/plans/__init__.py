"""Fitted models, registries and the prepare / train / evaluate run."""
