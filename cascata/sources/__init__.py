"""Graph readers, generators, graphs derived from relational tables, and sinks."""
