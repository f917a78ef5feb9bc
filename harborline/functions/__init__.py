"""functions of harborline."""
