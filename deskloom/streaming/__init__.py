"""streaming of the editorial-feed engine."""
