"""Where alerts go: console and webhook."""
