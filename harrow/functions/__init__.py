"""Column functions: text normalization, masking, measures, hashing, edits."""
