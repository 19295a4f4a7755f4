"""Readers, writers and the derived inputs that queries run on."""
