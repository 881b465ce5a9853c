"""streaming of clausemill."""
