"""DataFrame operators, usable in any combination."""
