"""Tables of recordings and hints, and the sinks of reports."""
