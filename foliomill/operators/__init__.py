"""Jobs of the operators layer."""
