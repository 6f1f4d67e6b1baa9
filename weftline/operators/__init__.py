"""DataFrame operators: parse, edges, traverse, rank, select, analyse, search, compare."""
