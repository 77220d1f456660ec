"""Operators of a training-data pipeline on text, pages, chats and vectors. Nothing else in the library imports this."""
