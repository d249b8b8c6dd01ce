"""Portfolio sorts and strategy evaluation on large asset panels, as Spark jobs."""
