"""Row-local operators over streams."""
