"""operators of the web-page engine."""
