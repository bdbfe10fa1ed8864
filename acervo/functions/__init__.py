"""Functions of the acervo engine."""
