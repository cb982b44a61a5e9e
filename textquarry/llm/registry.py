"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("simhash", "linededup", "secrets", "decontam", "toxicity", "sentencepieces", "licenses", "multiindex", "urlfilter", "quality")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"textquarry.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
