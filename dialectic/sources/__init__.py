"""Sources (readers, fixture views) and sinks."""
