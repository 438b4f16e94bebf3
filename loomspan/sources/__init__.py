"""sources of the web-page engine."""
