"""Reading and writing tables, responses and requests."""
