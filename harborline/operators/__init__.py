"""DataFrame-in, DataFrame-out analytics over the domain tables."""
