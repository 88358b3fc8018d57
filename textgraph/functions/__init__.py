"""Column-level functions: everything stays inside Catalyst."""
