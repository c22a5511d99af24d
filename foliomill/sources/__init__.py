"""Jobs of the sources layer."""
