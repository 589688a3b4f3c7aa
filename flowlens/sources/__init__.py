"""Sources, sinks and the derived input tables."""
