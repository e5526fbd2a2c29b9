"""Column-level functions: books, clocks, identities, options and labels."""
