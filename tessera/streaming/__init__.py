"""Structured Streaming form of the field split (see ``folder_split``)."""
