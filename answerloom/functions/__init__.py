"""Column functions and the few Arrow functions built-ins cannot replace."""
