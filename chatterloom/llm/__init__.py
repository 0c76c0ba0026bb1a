"""Training-data operators for language models."""
