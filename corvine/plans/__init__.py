"""Ready-made queries over the registered tables."""
