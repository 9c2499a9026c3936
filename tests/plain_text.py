"""The two normal forms of a text in plain Python, for comparison with the column expressions."""

import re
import unicodedata


def unaccented(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if unicodedata.combining(c) == 0)


def category_form(text):
    return "missing" if text is None else re.sub(r"[\s\x1c-\x1f_-]+", " ", unaccented(text)).strip()


def text_form(text):
    return "missing" if text is None else re.sub(r"[^a-z0-9]+", " ", unaccented(text)).strip()
