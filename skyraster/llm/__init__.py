"""Operators for preparing training text, their registered queries and the corpus pipeline's stages."""
