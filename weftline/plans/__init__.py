"""Projects derived from given tables, and the registered queries over them."""
