"""Analytics over text that behaves like memory, as Spark jobs."""
