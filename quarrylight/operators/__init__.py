"""DataFrame operators over the tables of schemas.py."""
