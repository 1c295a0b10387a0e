"""DataFrame operators: search, messages, routing, guards, tables, evaluation."""
