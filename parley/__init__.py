"""Conversation data at scale: stores, prompts, segments, commands and streamed answers on Spark."""
