"""Plan fragments shared by the operators: fact joins, pages, key lookups, ranking."""
