"""Entity registry, export and import specifications, and the plans built from them."""
