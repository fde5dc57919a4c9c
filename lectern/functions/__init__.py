"""Part of Lectern, see README."""
