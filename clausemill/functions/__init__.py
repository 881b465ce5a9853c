"""functions of clausemill."""
