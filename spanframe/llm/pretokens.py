"""Encoding through pre-tokens: each distinct pre-token is encoded once by the library's model and then found in a table.

A text is cut at the special strings that the definition adds, and each part is split into pre-tokens: here, by the
definition's own pattern, where all of its characters lie in Latin-1, else by the library's normalizer and
pre-tokenizer. Either way the pre-tokens are looked up. Only a definition that isn't byte-level, or whose special
strings have options, goes to the library text by text. All ways give the library's own result.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import kept_by_worker

#: Entries of a worker's cache before it falls back to the frequent ones, and the longest pre-token that is kept, in code
#: points: together they bound its bytes.
CACHE_ENTRIES, LONGEST_KEPT = 150_000, 48
#: Texts that the frequent entries are taken from, and the longest of them.
TABLE_ROWS, TABLE_LONGEST = 1_024, 8_192
#: The fixed split of byte-level BPE without a pattern of its own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level BPE: itself where it prints, else one from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


BYTE_CHARACTERS = "".join(byte_characters())


def vocabulary(definition: str) -> list[bytes]:
    """The bytes of each id: the characters of its entry, through the byte table in reverse."""
    back = {c: b for b, c in enumerate(byte_characters())}
    spec = json.loads(definition)
    out: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    out |= {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
    return [out.get(i, b"") for i in range(max(out, default=-1) + 1)]


class Splitter:
    """The split of one tokenizer definition."""

    def __init__(self, spec: dict, tokenizer):
        steps = _flat(spec.get("pre_tokenizer"), "pretokenizers")
        norms = _flat(spec.get("normalizer"), "normalizers")
        added = spec.get("added_tokens", [])
        self.special = [x["content"] for x in added]
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split
        plain = not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        #: Whether the pre-tokens of the library are what its model takes, written in the characters of the byte table.
        self.byte_level = plain and [x["type"] for x in steps].count("ByteLevel") == 1 and steps[-1]["type"] == "ByteLevel" and not steps[-1]["add_prefix_space"]
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.lower = any(x["type"] == "Lowercase" for x in norms)
        pattern = _pattern(steps, norms) if self.byte_level else None
        self.find = re.compile(latin1_pattern(pattern)).findall if pattern else None

    def split(self, text: str) -> list | None:
        """The pre-tokens, special strings among them as 1-tuples; None where only the library may encode."""
        if not self.byte_level:
            return None
        if not any(s in text for s in self.special):
            return self._pretokens(text)
        out: list = []
        for i, part in enumerate(self.at_special(text)):
            out += [(part,)] if i % 2 else self._pretokens(part)
        return out

    def _pretokens(self, text: str) -> list[str]:
        if self.find is not None and _in_latin1(text):
            return self.find(text.lower() if self.lower else text)
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]


def _in_latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _pattern(steps: list[dict], norms: list[dict]) -> str | None:
    """The pattern whose matches are the pre-tokens of a text in Latin-1, of a definition of a known form."""
    spaces = [x for x in norms if x["type"] == "Replace"]
    if any(x["type"] not in ("NFC", "Lowercase", "Replace") for x in norms) or any(x["pattern"] != {"Regex": r"\s+"} or x["content"] != " " for x in spaces):
        return None
    if len(steps) == 1:
        return BYTE_LEVEL if steps[0]["use_regex"] and not norms else None
    if len(steps) != 2 or steps[0]["type"] != "Split" or steps[1]["use_regex"]:
        return None
    whole = steps[0]["behavior"] == "Isolated" or (steps[0]["behavior"] == "Removed" and steps[0]["invert"])
    pattern = steps[0]["pattern"].get("Regex") if whole else None
    # white space that is part of pre-tokens would have to be replaced first
    return None if spaces and pattern and r"|\s" in pattern else pattern


def latin1_pattern(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N}, \s and \S spelled out for the characters of Latin-1, where the standard engine is faster."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        m = re.compile(r"\\p\{(\w+)\}|\\[sS]|\\.|.", re.DOTALL).match(pattern, i)
        unit = m[0]
        if m[1] or unit in ("\\s", "\\S"):
            negated = unit == "\\S"
            if negated and inside:
                raise ValueError(f"a negated class inside a class: {pattern}")
            one = regex.compile("\\s" if not m[1] else unit)
            members = "".join(f"\\x{c:02x}" for c in range(256) if one.match(chr(c)))
            out.append(members if inside else f"[{'^' * negated}{members}]")
        else:
            inside = {"[": True, "]": False}.get(unit, inside)
            out.append(unit)
        i = m.end()
    return "".join(out)


def _flat(step: dict | None, key: str) -> list[dict]:
    if step is None:
        return []
    return list(chain.from_iterable(_flat(x, key) for x in step[key])) if step["type"] == "Sequence" else [step]


def head(definition: str) -> dict:
    """A definition without its model, which is nearly all of it and which the library reads."""
    spec = json.loads(definition)
    del spec["model"]
    return spec


class PretokenTable:
    """Pre-token to value: frequent entries that stay, and a worker's own that are dropped together when they are many."""

    def __init__(self, frequent: dict, value, definition: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = head(definition)
        self.frequent, self.value, self.definition = frequent, value, definition
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model  # its pre-tokens are written in the characters of the byte table
        self.splitter = Splitter(spec, self.tokenizer)
        self.special = {(x["content"],): value([x["id"]]) for x in spec.get("added_tokens", [])}
        self.table = frequent | self.special
        self.most = entries + len(self.table)
        self.back: tuple[list[bytes], np.ndarray] | None = None

    def bytes_of_ids(self) -> tuple[list[bytes], np.ndarray]:
        """(bytes of each id, their lengths), made when they are first asked for."""
        if self.back is None:
            table = vocabulary(self.definition)
            self.back = table, np.array([len(x) for x in table], np.int64)
        return self.back

    def of(self, token: str):
        """The value of a pre-token that the table does not hold: encoded by the model, and kept if it is short."""
        written = codecs.charmap_decode(token.encode(), "strict", BYTE_CHARACTERS)[0]
        made = self.value([t.id for t in self.model.tokenize(written)])
        if len(token) <= LONGEST_KEPT:
            if len(self.table) >= self.most:
                self.table = self.frequent | self.special
            self.table[token] = made
        return made

    def lookup(self, texts: list[str], combine):
        """combine(values of the pre-tokens) of each text."""
        for text in texts:
            found = self.splitter.split(text)
            if found is None:
                yield self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            values = list(map(self.table.get, found))
            if None in values:
                new: dict = {}  # a pre-token of the text is encoded once, also where it is not kept
                for i, v in enumerate(values):
                    if v is None:
                        token = found[i]
                        if token not in new:
                            new[token] = self.of(token)
                        values[i] = new[token]
            yield combine(values)


def sample_texts(rows: DataFrame, n: int = TABLE_ROWS, longest: int = TABLE_LONGEST) -> list[str]:
    """At most n texts of at most `longest` code points each: what the driver fills the frequent entries from."""
    return [r[0] for r in rows.where(F.length("text") <= longest).select("text").limit(n).collect()]


def frequent_pretokens(texts: list[str], definition: str, value, entries: int) -> dict:
    """Values of the most frequent pre-tokens of a few texts, ties by code point."""
    table = PretokenTable({}, value, definition)
    counts: Counter[str] = Counter()
    for t in texts:
        counts.update(p for p in table.splitter.split(t) or () if isinstance(p, str) and len(p) <= LONGEST_KEPT)
    return {t: table.of(t) for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:entries]}


def worker_table(key: str, frequent: dict, value, definition: str, entries: int = CACHE_ENTRIES) -> PretokenTable:
    """This worker process's table for a key; it outlives tasks."""
    return kept_by_worker(key, lambda: PretokenTable(frequent, value, definition, entries))
