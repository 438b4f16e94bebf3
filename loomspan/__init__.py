"""Web-page analytics and training-data operators on Spark."""
