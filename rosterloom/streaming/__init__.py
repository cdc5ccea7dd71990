"""Streaming: documents that land in a folder are registered as they come."""
