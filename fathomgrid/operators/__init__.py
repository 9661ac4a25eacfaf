"""DataFrame-to-DataFrame operators, keyed by array configuration."""
