"""Streams of messages, mentions and documents."""
