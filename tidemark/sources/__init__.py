"""Sources and sinks of readings."""
