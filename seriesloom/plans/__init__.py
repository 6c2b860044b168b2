"""Whole jobs: extraction, training, prediction and archive scoring."""
