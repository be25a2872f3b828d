"""DataFrame operators, grouped by the kind of table they work on."""
