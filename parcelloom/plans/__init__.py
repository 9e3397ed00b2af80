"""Maps, plans, metrics and objectives."""
