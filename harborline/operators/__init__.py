"""operators of harborline."""
