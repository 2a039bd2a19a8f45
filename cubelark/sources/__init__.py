"""Where layers come from and where results go."""
