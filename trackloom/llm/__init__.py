"""Text operators of a training-data pipeline."""
