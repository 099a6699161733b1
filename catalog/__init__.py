"""Named queries over the given tables, each with the equivalent SQL where one exists."""
