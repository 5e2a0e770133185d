"""Query catalog (test-table instantiations of the operators) and their SQL twins."""
