"""Product matching and price analytics as Spark plans."""
