"""The registered queries: the library's operators put together over the given tables."""
