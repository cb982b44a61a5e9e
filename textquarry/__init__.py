"""textquarry: corpus analytics for language-model data, written for Spark."""
