"""Operators that prepare and search text for language models; nothing else in the library imports them."""
