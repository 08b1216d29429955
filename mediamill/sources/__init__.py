"""Sources and sinks of media files."""
