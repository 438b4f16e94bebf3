"""streaming of the web-page engine."""
