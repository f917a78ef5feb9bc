"""sources of harborline."""
