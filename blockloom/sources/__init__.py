"""Readers that give the engine its ``words``, ``pages``, ``lines`` and Markdown tables."""
