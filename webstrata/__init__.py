"""webstrata: telling personal blogs from corporate sites over stored pages, on Spark."""
