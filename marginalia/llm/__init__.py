"""Training-data operators over the library's pages and digest files."""
