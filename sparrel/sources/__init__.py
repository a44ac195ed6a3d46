"""Where tables come from, and the versioned store."""
