"""Reading and writing: files, nested pages, and the benchmark tables."""
