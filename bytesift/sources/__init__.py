"""Sources and sinks: files, text tables, and the engine's own table."""
