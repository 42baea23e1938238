"""Readers, payload decoders and writers."""
