"""DataFrame-to-DataFrame building blocks of the named queries."""
