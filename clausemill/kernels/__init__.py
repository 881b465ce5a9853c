"""kernels of clausemill."""
