"""Static capability and reachability analytics over source code, as Spark plans."""
