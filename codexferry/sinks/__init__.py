"""Writers. All write in parallel; none gathers its rows in one task."""
