"""Document exports and table writers."""
