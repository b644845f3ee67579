"""Sources (delimited reader, derived inventory view) and sinks."""
