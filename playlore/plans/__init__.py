"""The query library: each module holds a table of (query, SQL) pairs; ``registry`` collects them."""
