"""Sources and sinks of fixed-width records, and generated ones."""
