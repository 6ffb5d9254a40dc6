"""Asset, frame and document analytics as Spark queries."""
