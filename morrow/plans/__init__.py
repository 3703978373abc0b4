"""Jobs composed from the operators, with their stage boundaries."""
