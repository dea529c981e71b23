"""Column functions: expressions over text, numbers and identities."""
