"""Writing prepared tables and results."""
