"""Freely typed values to entries of a reference list.

The reference entries and their aliases form a trie, one for each field.  A value is searched in it with a Levenshtein
automaton (bit-parallel states, adjacent transpositions included) that returns every entry within a distance that depends
on the length.  Each distinct value is searched once, on the executors, and joined back to its rows.  Alias paths for
other spellings (as a scanner reads them, without spaces, with the words in order, abbreviated) are tries of their own,
searched to the same distance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spellings that stand for one another.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
#: Default of shapes a scanner confuses.
OCR = (("rn", "m"), ("ri", "n"), ("0", "o"), ("1", "i"), ("l", "i"), ("5", "s"), ("8", "b"), ("c", "e"), ("uu", "w"))
#: Default of words around a value that do not change what it names.
AFFIXES = r"^(?:neu|alt|fa|firma|ca|typ|siehe)\s*[:.]\s*|\s*\((?:alt|neu)\)$|\s+(?:gmbh|ag|kg|inc|ltd)\.?$|\s*,\s*(?:bestehend|neu|alt|vorhanden)$"


def repair(text: str) -> str:
    """Undo UTF-8 read as Latin-1."""
    if "Ã" in text or "Â" in text:
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    return text


def fold(text: str) -> str:
    """Case, umlauts, accents, separators and outer punctuation do not matter."""
    text = unicodedata.normalize("NFKC", repair(text)).casefold()
    for a, b in UMLAUTS.items():
        text = text.replace(a, b)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    text = re.sub(r"[_\-–/\s]+", " ", text).strip(" \t.,;:*?!»«\"'[](){}<>")
    return text


def bare(text: str, affixes: str = AFFIXES) -> str:
    """``fold`` without words that only accompany a value."""
    before, text = None, repair(text).strip().strip("»«\"'[]*? ").casefold()
    while before != text:
        before, text = text, re.sub(affixes, "", text).strip()
    return fold(text)


def ocr(text: str, shapes: Iterable[tuple[str, str]] = OCR) -> str:
    """Shapes a scanner confuses become one; applied to values and entries alike."""
    for a, b in shapes:
        text = text.replace(a, b)
    return text


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    entries: set[str] = field(default_factory=set)
    word: str = ""


class Trie:
    """Entries and their aliases; every alias path ends in the id of its entry."""

    def __init__(self, names: Iterable[tuple[str, str]]):
        self.root = Node()
        for name, entry in names:
            node = self.root
            for c in name:
                node = node.children.setdefault(c, Node())
            node.entries.add(entry)
            node.word = name

    def search(self, value: str, most: int) -> dict[str, tuple[int, str]]:
        """Entries within ``most`` edits: id -> (distance, the name it matched)."""
        masks: dict[str, int] = {}
        for i, c in enumerate(value):
            masks[c] = masks.get(c, 0) | 1 << i
        accept = 1 << len(value)
        start, bits = [], 0
        for j in range(most + 1):
            bits |= 1 << j
            start.append(bits & (accept << 1) - 1)
        found: dict[str, tuple[int, str]] = {}
        full = (accept << 1) - 1
        stack = [(self.root, start, None, 0)]
        while stack:
            node, states, before, last = stack.pop()
            if node.entries:
                for j, s in enumerate(states):
                    if s & accept:
                        for entry in node.entries:
                            if entry not in found or (j, node.word) < found[entry]:
                                found[entry] = (j, node.word)
                        break
            for c, child in node.children.items():
                mask = masks.get(c, 0)
                new = [(states[0] & mask) << 1]
                for j in range(1, most + 1):
                    low = states[j - 1]
                    s = (states[j] & mask) << 1 | low | low << 1 | new[j - 1] << 1
                    if before is not None:
                        s |= (((before[j - 1] & mask) << 1) & last) << 1
                    new.append(s & full)
                if new[-1]:
                    stack.append((child, new, states, mask))
        return found

    def abbreviated(self, words: list[str]) -> set[str]:
        """Entries whose words begin with the given ones that end in a dot (two letters at least) and equal the others."""
        level = [self.root]
        for n, word in enumerate(words):
            stem = word.removesuffix(".")
            level = [x for node in level if (x := _down(node, (" " if n else "") + stem))]
            if word != stem:  # the rest of the word, up to a space or the end
                level = [y for node in level for y in _word_ends(node)] if len(stem) > 1 else []
        return {e for node in level for e in node.entries}


def _down(node: Node, text: str) -> Node | None:
    for c in text:
        if (node := node.children.get(c)) is None:  # type: ignore[assignment]
            return None
    return node


def _word_ends(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        if node.entries or " " in node.children:
            yield node
        stack += [child for c, child in node.children.items() if c != " "]


def reach(length: int) -> int:
    """Edits allowed for a name of this length."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else 3 if length < 16 else 4


class Matcher:
    """Finds the entry of one field that a value stands for."""

    def __init__(self, names: list[tuple[str, str]], affixes: str = AFFIXES, shapes: Iterable[tuple[str, str]] = OCR):
        self.affixes, self.shapes = affixes, tuple(shapes)
        # an umlaut may have lost its dots, so both spellings are alias paths
        folded = {(fold(x), e) for n, e in names for x in (n, n.translate(str.maketrans("äöüÄÖÜ", "aouAOU"))) if fold(x)}
        self.plain = Trie(folded)
        self.scanned = Trie({(ocr(n, self.shapes), e) for n, e in folded})
        self.swapped = Trie({(" ".join(sorted(n.split())), e) for n, e in folded if " " in n})
        self.joined = Trie({(n.replace(" ", ""), e) for n, e in folded})

    def _forms(self, value: str) -> Iterator[tuple[Trie, str, float]]:
        """What is searched in which trie, and what that costs beside the edits."""
        for text, extra in dict.fromkeys(((fold(value), 0.0), (bare(value, self.affixes), 0.25))):
            if text:
                yield self.plain, text, extra
                yield self.scanned, ocr(text, self.shapes), extra + 0.5
                yield self.joined, text.replace(" ", ""), extra + 0.25
                if " " in text:
                    yield self.swapped, " ".join(sorted(w.strip(",") for w in text.split())), extra + 0.5

    def candidates(self, value: str, most: int | None = None) -> dict[str, float]:
        """Every entry within reach (of at most ``most`` edits, if given), with its distance in edits."""
        best: dict[str, float] = {}
        for trie, text, extra in self._forms(value):
            limit = reach(len(text) + 1)
            for entry, (distance, word) in trie.search(text, limit if most is None else min(limit, most)).items():
                if distance <= reach(len(word)):
                    best[entry] = min(best.get(entry, 99.0), distance + extra)
        words = text_words(value)
        if any(w.endswith(".") for w in words):
            for entry in self.plain.abbreviated(words):
                best[entry] = min(best.get(entry, 99.0), 0.5)
        return best

    def match(self, value: str) -> str | None:
        """The one nearest entry; none if nothing is within reach or two are equally near.

        The search widens edit by edit and ends once nothing farther can be as near as what it has found, so the result
        is that of a search over everything within reach.
        """
        longest = max((len(text) for _, text, _ in self._forms(value)), default=0)
        for most in range(reach(longest + 1) + 1):
            best = sorted((d, e) for e, d in self.candidates(value, most).items())
            if best and best[0][0] + 0.5 <= most + 1:
                break
        if not best or (len(best) > 1 and best[1][0] - best[0][0] < 0.5):
            return None
        return best[0][1]


def text_words(value: str) -> list[str]:
    """Folded words, a final dot kept."""
    return [fold(w) + ("." if w.endswith(".") else "") for w in value.split() if fold(w)]


def aliases(description: str | None) -> list[str]:
    """The further names a description lists after ``auch:``."""
    if not description or "auch:" not in description:
        return []
    return [a.strip() for a in description.split("auch:", 1)[1].split(";") if a.strip()]


@lru_cache(maxsize=4)
def _matchers(lists: tuple) -> dict[str, Matcher]:
    return {name: Matcher(list(entries)) for name, entries in lists}


def _searched(values: DataFrame, lists: dict[str, list[tuple[str, str]]], find, schema: str) -> DataFrame:
    """``find(matcher, value)`` rows of each distinct (field, value); a field without a list and a blank value find nothing."""
    held = tuple((k, tuple(sorted(v))) for k, v in sorted(lists.items()))
    spark = values.sparkSession
    share = spark.sparkContext.broadcast(held)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = _matchers(share.value)
        for batch in batches:
            rows = [
                (f, v, *found)
                for f, v in zip(batch["field"], batch["value"], strict=True)
                for found in find(matchers[f] if f in matchers and v and v.strip() else None, v)
            ]
            yield pd.DataFrame(rows, columns=["field", "value", *names], dtype="object")

    names = [part.split()[0] for part in schema.split(", ")]
    # the search costs far more than its bytes tell, so the distinct values are spread over all tasks
    spread = values.select("field", "value").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInPandas(search, f"field string, value string, {schema}")


def map_values(values: DataFrame, lists: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """field, value, entry_id for distinct (field, value) rows; entry_id is null where no entry is meant.

    ``lists`` has (name or alias, entry id) of each field and must be small enough for every worker (reference lists).
    Fields without a list and blank values match nothing.
    """
    return _searched(values, lists, lambda m, v: [(m.match(v) if m else None,)], "entry_id string")


def near_entries(values: DataFrame, lists: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """field, value, entry_id, distance: every entry within the length-dependent distance of each distinct value.

    Values without any have no rows.  Distances are in edits; alias paths other than the plain name add a part of one.
    """
    return _searched(values, lists, lambda m, v: sorted(m.candidates(v).items()) if m else [], "entry_id string, distance double")
