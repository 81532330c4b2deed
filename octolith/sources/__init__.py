"""Point clouds from tables, files and generators; sinks."""
