"""Reading and writing: vector files, encoded vectors, metadata, project trees, index tables."""
