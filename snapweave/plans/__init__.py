"""What a command runs: sources, operators, gates and renderers put together."""
