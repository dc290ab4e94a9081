"""Sources and sinks: object stores, file scans, variables."""
