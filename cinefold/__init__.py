"""Feature building, training and request scoring for rating data, as Spark jobs."""
