"""Plans of the acervo engine."""
