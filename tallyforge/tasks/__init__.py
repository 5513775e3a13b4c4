"""Analysis tasks: registry, runs over a workspace, coverage."""
