"""Where vectors come from and where they are kept."""
