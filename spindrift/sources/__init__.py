"""Reading and writing records and their schemas."""
