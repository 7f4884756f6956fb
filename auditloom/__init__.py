"""Web-quality analytics over stored pages and texts, written as Spark DataFrame plans."""
