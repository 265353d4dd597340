"""Reading the releases, writing results, and tables derived from an order warehouse."""
