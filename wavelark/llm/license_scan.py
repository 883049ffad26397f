"""License notices: exact phrases, and a fuzzy search for short notices by pigeonhole seeds and bounded-error regexes.

A notice that is allowed e errors is split into e + 1 pieces; any place with at most e errors holds one piece unchanged. The
pieces are searched exactly, and only around such seeds does the regex library's bounded-error matching decide and give spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wavelark.llm.common import id_and_text

#: Phrases of the base labels, word by word.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices searched with errors, and the label each gives.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
    "gnu affero general public license": "agpl",
    "eclipse public license version 2 0": "epl-2",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the software is provided as is without warranty of any kind": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "boost software license version 1 0": "bsl-1",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "free and unencumbered software released into the public domain": "unlicense",
}
#: One error is allowed for so many characters of a notice.
CHARS_PER_ERROR = 10

_TABLE = bytes(32 if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def errors_allowed(notice: str, chars_per_error: int = CHARS_PER_ERROR) -> int:
    return max(1, len(notice) // chars_per_error)


def seeds(notice: str, errors: int) -> list[tuple[int, bytes]]:
    """The pieces of a notice, with their offsets."""
    raw = notice.encode()
    cuts = [round(i * len(raw) / (errors + 1)) for i in range(errors + 2)]
    return [(a, raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class NoticeSearch:
    def __init__(self, notices: dict[str, str], chars_per_error: int) -> None:
        self.rules = []
        for notice, label in notices.items():
            errors = errors_allowed(notice, chars_per_error)
            pattern = regex.compile(rb"(?b)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(notice.encode(), literal_spaces=True), errors))
            self.rules.append((label, notice.encode(), errors, pattern, seeds(notice, errors)))

    def find(self, text: bytes) -> list[tuple[str, int, int, int, float]]:
        """Label, start, end, errors and similarity of each place. text: words joined by one space."""
        out = []
        for label, notice, errors, pattern, pieces in self.rules:
            places: list[tuple[int, int]] = []
            for offset, piece in pieces:
                at = text.find(piece)
                while at >= 0:
                    places.append((max(0, at - offset - errors), at - offset + len(notice) + errors + 1))
                    at = text.find(piece, at + 1)
            places.sort()
            end = -1
            for a, b in places:
                if b <= end:
                    continue
                # a window begins and ends where a word does, or the pattern could not tell
                a = text.rfind(b" ", 0, max(a, end, 0) + 1) + 1 if max(a, end) > 0 else 0
                stop = text.find(b" ", b)
                match = pattern.search(text, max(a, end if end > 0 else 0), stop if stop >= 0 else len(text))
                if match:
                    n = sum(match.fuzzy_counts)
                    out.append((label, match.start(), match.end(), n, 1 - n / len(notice)))
                    end = match.end()
        return out


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,errors:int>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32())]))


def _scan(phrases: dict[str, str], notices: dict[str, str], chars_per_error: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices, chars_per_error)
        exact = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
                    words = [w for w in words if w]
                    flat = b" ".join(words)
                    padded = b" " + flat + b" "
                    places, base = [], set()
                    for phrase, label in exact:
                        at = padded.find(phrase)
                        while at >= 0:
                            places.append(padded.count(b" ", 0, at))
                            base.add(label)
                            at = padded.find(phrase, at + 1)
                    found = search.find(flat)
                    spans = [{"label": x[0], "first_word": flat.count(b" ", 0, x[1]), "last_word": flat.count(b" ", 0, x[2]), "errors": x[3]} for x in sorted(found, key=lambda x: (x[1], x[0]))]
                    score = 1.0 if places else max((x[4] for x in found), default=0.0)
                    rows.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in found})), score, spans))
                kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), _SPANS]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A-Z is lower-cased; words are runs of ASCII letters and digits and of anything beyond ASCII. n_base counts the places where a
    phrase's words stand consecutively, first_word and last_word are the smallest and largest start of them. labels adds those
    of notices found with errors; spans tells where (first and last word). score is 1 with a base place, else the similarity of
    the best notice, else 0. Null and empty texts have no words, no labels (empty strings) and a score of 0; repeated rows get
    equal results, null ids stay null, an empty table gives no rows.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan(phrases or PHRASES, notices or NOTICES, chars_per_error), _SCHEMA)
