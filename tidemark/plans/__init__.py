"""Plans of the feed engine."""
