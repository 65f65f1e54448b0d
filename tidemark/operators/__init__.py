"""DataFrame compositions for what the DataFrame API has no single operator for."""
