"""Localised messages of failures."""

from .locale import Catalog, Locale, Translator, english, simplified_chinese

__all__ = ["Catalog", "Locale", "Translator", "english", "simplified_chinese"]
