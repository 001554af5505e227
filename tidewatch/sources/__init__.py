"""Where events come from: tables, JSON messages, HTTP and a message log."""
