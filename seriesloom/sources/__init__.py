"""Reading and writing tables, nested JSON, tag documents and folder inventories."""
