"""Readers, writers and the derivation of daily series from fact tables."""
