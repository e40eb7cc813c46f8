"""Part of corpuscle: see the README."""
