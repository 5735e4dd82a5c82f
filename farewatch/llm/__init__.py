"""Training-data operators on Spark (optional; nothing else in the library imports them)."""
