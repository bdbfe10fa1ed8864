"""Sources of the acervo engine."""
