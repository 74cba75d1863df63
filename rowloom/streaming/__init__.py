"""The stateless operations and windowed summaries over streams. An extension: rows of a stream have no position."""
