"""Media-library and dialogue-timing analytics on Spark."""
