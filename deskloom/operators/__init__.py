"""operators of the editorial-feed engine."""
