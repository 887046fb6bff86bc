"""Source definitions, table access and batch readers."""
