"""URL surface analytics on Spark: parse, gate, template and deduplicate very large URL lists."""
