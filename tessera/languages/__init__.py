"""Languages: their readers, and the registry of their plugins."""
