"""Character and phrase conversion (simplified to traditional script, say) by a table that the caller gives, in built-in functions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossia.functions.text import let


def trie_pattern(phrases) -> str:
    """A pattern for any of the phrases, the longest that fits: branches share their beginnings, so a place is tried once and not for each phrase."""
    root: dict = {}
    for p in phrases:
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = {}

    def shown(node: dict) -> str:
        own = [re.escape(c) + shown(below) for c, below in sorted(node.items()) if c]
        if not own:
            return ""
        inner = own[0] if len(own) == 1 and "" not in node else f"(?:{'|'.join(own)})"
        return f"{inner}?" if "" in node else inner

    return shown(root)


def converted(c: Column, table: Mapping[str, str]) -> Column:
    """A text with each longest phrase of the table, from left to right, by its entry; what the table doesn't have stays.

    Single characters that become one are translated; phrases, and characters that become several or none, are found by one pattern, and
    what lies between them is translated. Time is in proportion to the text. If no entry holds a key of the table, converting twice
    changes nothing more.
    """
    single = {k: v for k, v in table.items() if len(k) == 1 and len(v) == 1}
    phrases = {k: v for k, v in table.items() if k and k not in single}
    translated = lambda x: F.translate(x, "".join(single), "".join(single.values())) if single else x
    if not phrases:
        return translated(c)
    pattern = trie_pattern(phrases)
    known = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])

    def joined(x):
        pairs = F.transform(x["between"], lambda t, i: F.concat(translated(t), F.coalesce(F.try_element_at(known, F.coalesce(F.get(x["found"], i), F.lit(""))), F.lit(""))))
        return F.array_join(pairs, "")

    parts = F.struct(F.regexp_extract_all(c, F.lit(pattern), 0).alias("found"), F.split(c, pattern).alias("between"))
    return F.when(c.rlike(pattern), let(parts, joined)).otherwise(translated(c))
