"""Release files, side inputs, and their layouts."""
