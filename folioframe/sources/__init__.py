"""Where panels come from and where results go."""
