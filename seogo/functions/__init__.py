"""Part of the seogo engine; see README.md for the module map."""
