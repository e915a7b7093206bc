"""Jobs: compositions of operators that a user calls."""
