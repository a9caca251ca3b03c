"""pagemill: web pages in, a searchable corpus and usage reports out, as Spark jobs."""
