"""Market data derived from the driver's generic tables, the registered queries over it, and their SQL."""
