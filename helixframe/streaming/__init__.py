"""Structured Streaming forms of batch operators (an extension: the batch forms are the reference semantics)."""
