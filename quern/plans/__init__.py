"""Plans: the query catalogue and its SQL twins."""
