"""plans of clausemill."""
