"""functions of the web-page engine."""
