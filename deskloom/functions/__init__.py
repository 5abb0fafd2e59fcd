"""functions of the editorial-feed engine."""
