"""Operators for training-corpus pipelines; nothing else in loam imports this package."""
