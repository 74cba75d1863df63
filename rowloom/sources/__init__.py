"""Reading and writing frames."""
