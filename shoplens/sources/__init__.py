"""Sources: the given test tables mapped to the data model, and file/stream readers."""
