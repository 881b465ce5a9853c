"""operators of clausemill."""
