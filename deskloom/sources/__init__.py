"""sources of the editorial-feed engine."""
