"""Operators of the acervo engine."""
