"""Operators for training-data pipelines over text, chat, page and vector tables."""
