"""DataFrame operators; each takes a plain specification and returns a lazy DataFrame."""
