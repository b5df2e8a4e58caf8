"""Step specifications and their replay over a table environment."""
