"""Script-to-narration analytics and corpus operators as Spark DataFrame transformations."""
