"""Frames, positions and the selector language."""
