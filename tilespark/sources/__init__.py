"""Where features come from and tiles go."""
