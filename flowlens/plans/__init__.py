"""Process models and the registry of queries."""
