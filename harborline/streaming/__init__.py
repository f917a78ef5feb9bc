"""streaming of harborline."""
