"""DataFrame operators: every one takes a DataFrame first and returns a DataFrame."""
