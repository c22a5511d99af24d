"""Jobs of the streaming layer."""
