"""Structured Streaming forms of the mailbox and file operators."""
