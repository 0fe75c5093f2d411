"""License phrases and fuzzy search for short notices in whole texts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence

import ahocorasick
import regex
from pyspark.sql import DataFrame

from taskatlas.llm.batches import score_texts
from taskatlas.llm.words import byte_words

# Fixed values of the query's contract: phrases that count wherever their words stand in a row.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Short notices searched with errors: text in the form of the words here, and label.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 1 0", "apache-1"),
    ("licensed under the apache license version 1 1", "apache-1"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("mozilla public license version 1 0", "mpl-1"),
    ("mozilla public license version 1 1", "mpl-1"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("this software is provided as is without warranty of any kind", "no-warranty"),
    ("all rights reserved", "reserved"),
)
ERROR_SHARE = 0.1  # edits allowed per character of a notice

# Label, first byte, end byte, edits, similarity.
Place = tuple[str, int, int, int, float]


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces with their offsets; a copy with so many edits keeps one of them whole."""
    parts = errors + 1
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeSearch:
    """Places of a notice as whole words with at most ``errors`` edits, verified by the regex library.

    The library spends no edit on a letter that already fits, so with an open end it misses
    places whose last letters are lacking. Hence each run of whole words of a fitting length
    is matched from its first to its last letter.
    """

    def __init__(self, notice: str, errors: int):
        self.least, self.most = len(notice) - errors, len(notice) + errors
        self.pattern = regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}")

    def find(self, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        """First letter, end and edits of places between blanks that do not overlap; where
        places do, the one with the fewest edits counts, then the first."""
        blanks = [p for p in range(low, high) if text[p] == " "]
        places = []
        for i, before in enumerate(blanks):
            first = before + 1
            for end in blanks[bisect_left(blanks, first + self.least, i) : bisect_right(blanks, first + self.most, i)]:
                if match := self.pattern.fullmatch(text, first, end):
                    places.append((sum(match.fuzzy_counts), first, end))
        kept: list[tuple[int, int, int]] = []
        for edits, first, end in sorted(places):
            at = bisect_left(kept, (first, end, edits))
            if (at == 0 or kept[at - 1][1] <= first) and (at == len(kept) or end <= kept[at][0]):
                kept.insert(at, (first, end, edits))
        return kept


def nearest_only(found: list[Place]) -> list[Place]:
    """The places less those that share over half of the shorter one's letters with a place of fewer edits."""
    found = sorted(found, key=lambda f: f[1:3])
    beaten = set()
    for i, (_, first, last, edits, _) in enumerate(found):
        for j in range(i + 1, len(found)):
            _, other_first, other_last, other_edits, _ = found[j]
            if other_first >= last:
                break
            if 2 * (min(last, other_last) - other_first) > min(last - first, other_last - other_first) and edits != other_edits:
                beaten.add(i if other_edits < edits else j)
    return [f for i, f in enumerate(found) if i not in beaten]


def make_finder(
    phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], error_share: float
) -> Callable[[bytes], tuple[list[tuple[str, int]], list[Place]]]:
    """A function from normal text (words between single blanks, UTF-8) to places of
    phrases ``(label, first byte)`` and notices ``(label, first byte, end byte, edits,
    similarity)``."""
    machine = ahocorasick.Automaton()
    owners: dict[str, list[tuple[int, int, int]]] = {}
    patterns = []
    # A phrase may have no edit: its one seed is all of it with the blanks around.
    searched = [(f" {text} ", label, 0) for text, label in phrases]
    searched += [(text, label, max(1, int(len(text) * error_share))) for text, label in notices]
    for n, (text, label, errors) in enumerate(searched):
        patterns.append((NoticeSearch(text, errors), errors, len(text), label))
        for offset, piece in seeds(text, errors):
            owners.setdefault(piece, []).append((n, offset, len(piece)))
    for piece, of in owners.items():
        machine.add_word(piece, of)
    machine.make_automaton()

    def find(normal: bytes) -> tuple[list[tuple[str, int]], list[Place]]:
        text = normal.decode("latin-1")  # one character for each byte, so offsets are bytes
        places, found = [], []
        windows: dict[int, list[list[int]]] = {}
        for end, of in machine.iter(text):
            for n, offset, length in of:
                _, errors, size, label = patterns[n]
                start = end + 1 - length - offset
                if not errors:
                    places.append((label, start))
                    continue
                # One letter more at each side, where the blanks are.
                low, high = max(0, start - errors - 1), min(len(text), start + size + errors + 1)
                spans = windows.setdefault(n, [])
                if spans and low <= spans[-1][1]:
                    # Seeds come by their ends, so a later one may start earlier.
                    spans[-1] = [min(low, spans[-1][0]), max(high, spans[-1][1])]
                else:
                    spans.append([low, high])
        for n, spans in windows.items():
            search, _, size, label = patterns[n]
            for low, high in spans:
                found += [(label, first, last, edits, 1.0 - edits / size) for first, last, edits in search.find(text, low, high)]
        return places, nearest_only(found)

    return find


def scan_notices(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES, error_share: float = ERROR_SHARE,
) -> DataFrame:
    """Per row: ``doc_id, n_words, places, notices``.

    ``places`` lists ``(label, word)`` for every place where the words of a phrase
    stand in a row, ``notices`` lists ``(label, first_word, last_word, edits,
    similarity)`` of the fuzzy search: exact seeds, one more than the edits allowed,
    locate candidates; the regex library's bounded-error
    match of runs of whole words verifies them; of places of two notices that overlap the one with
    fewer edits counts. Row-local, on whole texts. Null and empty texts have no words and no places; repeated rows repeat;
    an empty table gives no rows; other columns are ignored.
    """

    def make():
        find = make_finder(phrases, notices, error_share)

        def run(texts: list[str | None]) -> list[list]:
            counts, places, fuzzy = [], [], []
            for text in texts:
                tokens = byte_words(text)
                normal = b" " + b" ".join(tokens) + b" "
                at, spans = find(normal) if tokens else ([], [])
                counts.append(len(tokens))
                # The word that begins after a blank has as many words before it as there are blanks.
                places.append([{"label": label, "word": normal.count(b" ", 0, first)} for label, first in at])
                fuzzy.append([
                    {"label": label, "first_word": normal.count(b" ", 0, first) - 1, "last_word": normal.count(b" ", 0, last) - 1, "edits": edits, "similarity": share}
                    for label, first, last, edits, share in spans
                ])
            return [counts, places, fuzzy]

        return run

    schema = (
        "n_words long, places array<struct<label:string,word:long>>, "
        "notices array<struct<label:string,first_word:long,last_word:long,edits:int,similarity:double>>"
    )
    return score_texts(documents, id_col, text_col, make, schema)
