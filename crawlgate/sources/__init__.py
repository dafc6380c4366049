"""Where robots files come from."""
