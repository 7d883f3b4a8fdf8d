"""Query catalogue, its SQL twins and the guarded SQL entry."""
