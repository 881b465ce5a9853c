"""sources of clausemill."""
