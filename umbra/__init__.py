"""Umbra: corpus-scale text de-identification, leak analytics and training-data operators on Spark."""
