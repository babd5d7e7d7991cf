"""Conversation-stream analytics as user-level Spark operators."""
