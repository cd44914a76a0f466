"""panelloom: factor research on monthly security panels, as Spark jobs."""
