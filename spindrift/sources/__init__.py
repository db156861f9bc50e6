"""Tables the engine reads, and sinks it writes."""
