"""Whole jobs: train, evaluate."""
