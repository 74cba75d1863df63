"""The operations on frames, a module for each family."""
