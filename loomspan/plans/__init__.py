"""plans of the web-page engine."""
