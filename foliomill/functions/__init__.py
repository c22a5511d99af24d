"""Jobs of the functions layer."""
