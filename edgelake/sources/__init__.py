"""Sources of bars and stores of results."""
