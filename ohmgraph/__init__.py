"""Information flow on knowledge graphs, as Spark plans."""
