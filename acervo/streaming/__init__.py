"""Streaming of the acervo engine."""
