"""License scans with a positional rare-token index.

Templates are licence texts as sequences of words, with mandatory key phrases. The index holds for each word of the key
phrases its postings (phrase, place in the phrase), and its weight, the inverse document frequency over all documents. A
file looks up its own licence words from the highest weight down. A word opens the phrases that it leads, those of which
it is the rarest word: each of its places in the file less its place in the phrase is a possible start, and the starts are
intersected with those of the phrase's other words, the rarest first. A phrase whose rarest word a file lacks is never
touched. A label needs all of its key phrases.

The score is 1 with a base label, else 0 without a label, else the largest share, over the texts of the file's labels, of a
text's weight that stands in the file at the right places. A text is laid where a key phrase was found, less the phrase's
place in the text, and compared word by word.

Defined cases: null text is empty; overlapping and repeated places all count; ties of weight are ordered by word; extra
columns and null ids are carried or ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.llm import common

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Mandatory key phrases of each label that the method adds, and licence texts that hold them, as words.
TEMPLATES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "apache-2.0": (("apache license", "version 2 0"), (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    )),
    "bsd": (("redistribution and use in source and binary forms",), (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    )),
    "cc-by-nc": (("cc by nc",), ("licensed under cc by nc 4 0", "licensed under cc by nc sa 4 0")),
    "cc-by-sa": (("cc by sa",), ("licensed under cc by sa 4 0", "licensed under cc by sa 3 0")),
    "cc0": (("cc0",), ("cc0 public domain dedication", "released under cc0 1 0")),
    "gpl-3": (("gnu general public license", "version 3"), (
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 "
        "of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
    )),
    "lgpl": (("lesser general public license",), (
        "licensed under the gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either "
        "version 2 1 of the license or at your option any later version",
    )),
    "mit": (("mit license",), ("licensed under the mit license", "released under the mit license")),
    "mit-text": (("permission is hereby granted free of charge",), (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    )),
    "mpl": (("mozilla public license",), (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    )),
}

_OTHER = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits, lower-cased, and of any characters beyond ASCII."""
    return common.text_of(text).encode().translate(_OTHER).split()


PHRASES: list[tuple[bytes, ...]] = sorted({tuple(p.encode().split()) for p in [*BASE, *(x for must, _ in TEMPLATES.values() for x in must)]})
#: (phrase, place in it) by word, for every word of the templates; words outside key phrases have none.
POSTINGS: dict[bytes, list[tuple[int, int]]] = {w.encode(): [] for must, texts in TEMPLATES.values() for t in texts for w in t.split()}
for _i, _phrase in enumerate(PHRASES):
    for _at, _word in enumerate(_phrase):
        POSTINGS.setdefault(_word, []).append((_i, _at))
KEY_WORDS = {w for w, x in POSTINGS.items() if x}


def phrase_places(phrase: tuple[bytes, ...], text: list[bytes]) -> list[int]:
    return [i for i in range(len(text) - len(phrase) + 1) if tuple(text[i : i + len(phrase)]) == phrase]


#: Of each label its key phrases' numbers, and its texts with the places of key phrases in them.
LABELS: dict[str, tuple[list[int], list[tuple[list[bytes], list[tuple[int, int]]]]]] = {}
for _label, (_must, _texts) in TEMPLATES.items():
    _keys = [PHRASES.index(tuple(p.encode().split())) for p in _must]
    LABELS[_label] = _keys, [(t.encode().split(), [(k, q) for k in _keys for q in phrase_places(PHRASES[k], t.encode().split())]) for t in _texts]


def weights(total: int, counts: dict[bytes, int]) -> dict[bytes, int]:
    """Inverse document frequencies in whole thousandths, so that sums are exact."""
    return {w: math.floor(1000 * (math.log((1 + total) / (1 + counts.get(w, 0))) + 1)) for w in POSTINGS}


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """The weight of each licence word over all documents. The words are the templates' own, so their counts are a bounded table."""

    def count(batches):
        total, tally = 0, dict.fromkeys(POSTINGS, 0)
        for batch in common.slices(batches, 0):
            for text in batch.column(0).to_pylist():
                total += 1
                for w in tally.keys() & set(words_of(text)):
                    tally[w] += 1
        names = [None, *(w.decode() for w in tally)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total, *tally.values()], pa.int64())], ["word", "n"])

    counted = {r.word: r.n for r in docs.select(text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return weights(counted.pop(None, 0), {w.encode(): n for w, n in counted.items()})


def phrase_order(idf: dict[bytes, float]) -> list[list[tuple[bytes, int]]]:
    """Each phrase's (word, place), the highest weight first."""
    return [sorted(((w, i) for i, w in enumerate(p)), key=lambda x: (-idf[x[0]], x[0], x[1])) for p in PHRASES]


def phrase_starts(words: list[bytes], orders: list[list[tuple[bytes, int]]], idf: dict[bytes, float]) -> dict[int, list[int]]:
    """Starts of each phrase found, by relative position: the file's licence words, the highest weight first, open the phrases that they lead."""
    present = KEY_WORDS & set(words)
    if not present:
        return {}
    places: dict[bytes, list[int]] = {w: [] for w in present}
    for at, w in enumerate(words):
        if w in present:
            places[w].append(at)
    sets: dict[bytes, set[int]] = {}
    found = {}
    for w in sorted(present, key=lambda w: (-idf[w], w)):
        for i, place in POSTINGS[w]:
            if orders[i][0] != (w, place):
                continue  # another word of the phrase is rarer
            starts = [p - place for p in places[w] if p >= place]
            for other, at in orders[i][1:]:
                if other not in present:
                    starts = []
                elif starts:
                    here = sets.setdefault(other, set(places[other]))
                    starts = [s for s in starts if s + at in here]
                if not starts:
                    break
            if starts:
                found[i] = starts
    return found


def share(words: list[bytes], text: list[bytes], starts: set[int], idf: dict[bytes, float]) -> float:
    """The largest share of a licence text's weight that stands in the file, over the starts."""
    best = 0
    for start in starts:
        first, last = max(0, -start), min(len(text), len(words) - start)
        best = max(best, sum(idf[text[i]] for i in range(first, last) if words[start + i] == text[i]))
    return best / sum(idf[w] for w in text)


def scan(words: list[bytes], orders: list, idf: dict[bytes, float]) -> tuple[int, int | None, int | None, str, str, float]:
    """n_base, first_word, last_word, base_labels, labels, score."""
    found = phrase_starts(words, orders, idf)
    if not found:
        return 0, None, None, "", "", 0.0
    base = {BASE[p]: found[i] for p in BASE if (i := PHRASES.index(tuple(p.encode().split()))) in found}
    starts = [s for x in base.values() for s in x]
    best = 1.0 if base else 0.0
    labels = set(base)
    for label, (keys, texts) in LABELS.items():
        if all(k in found for k in keys):
            labels.add(label)
            best = max(best, *(share(words, text, {s - q for k, q in laid for s in found[k]}, idf) for text, laid in texts))
    return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    idf = inverse_frequencies(docs, text_col)
    orders = phrase_order(idf)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in common.slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                rows.append((len(words), *scan(words, orders, idf)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def op7_license_scan(docs: DataFrame) -> DataFrame:
    return scan_documents(docs)


def _rows(rows: list[tuple]) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else f"'{x}'" if isinstance(x, str) else "[" + ", ".join(f"'{w}'" for w in x) + "]"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def _sql() -> str:
    """DuckDB: phrases found by comparing words from every place of their first one; texts laid out word by word."""
    phrases = [(i, [w.decode() for w in p]) for i, p in enumerate(PHRASES)]
    base = [(PHRASES.index(tuple(p.encode().split())), label) for p, label in BASE.items()]
    must = [(label, k) for label, (keys, _) in LABELS.items() for k in keys]
    texts = [(label, n, j, w.decode()) for label, (_, some) in LABELS.items() for n, (t, _) in enumerate(some) for j, w in enumerate(t)]
    laid = [(label, n, k, q) for label, (_, some) in LABELS.items() for n, (_, places) in enumerate(some) for k, q in places]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases(k, words) AS (VALUES {_rows(phrases)}
), base(k, label) AS (VALUES {_rows(base)}
), must(label, k) AS (VALUES {_rows(must)}
), texts(label, n, j, word) AS (VALUES {_rows(texts)}
), laid(label, n, k, q) AS (VALUES {_rows(laid)}
), vocabulary AS (SELECT word FROM texts UNION SELECT unnest(words) FROM phrases
), spots AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), counted AS (SELECT word, count(DISTINCT r) AS n FROM spots WHERE word IN (FROM vocabulary) GROUP BY word
), weighed AS (
  SELECT word, CAST(floor(1000 * (ln((1 + (SELECT count(*) FROM docs)) / CAST(1 + coalesce(n, 0) AS DOUBLE)) + 1)) AS BIGINT) AS weight FROM vocabulary LEFT JOIN counted USING (word)
), hits AS (
  SELECT s.r, p.k, s.i - 1 AS i FROM spots s JOIN phrases p ON s.word = p.words[1] JOIN docs d ON d.r = s.r WHERE d.w[s.i : s.i + len(p.words) - 1] = p.words
), base_hits AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits JOIN base USING (k) GROUP BY r
), labelled AS (
  SELECT r, m.label FROM (SELECT DISTINCT r, k FROM hits) h JOIN must m USING (k) GROUP BY r, m.label HAVING count(*) = (SELECT count(*) FROM must x WHERE x.label = m.label)
), starts AS (
  SELECT DISTINCT h.r, l.label, l.n, h.i - l.q AS start FROM labelled g JOIN laid l USING (label) JOIN hits h ON h.r = g.r AND h.k = l.k
), matched AS (
  SELECT s.r, s.label, s.n, s.start, sum(v.weight) AS weight FROM starts s JOIN texts t ON t.label = s.label AND t.n = s.n JOIN spots p ON p.r = s.r AND p.i - 1 = s.start + t.j AND p.word = t.word
  JOIN weighed v ON v.word = t.word GROUP BY ALL
), whole AS (SELECT label, n, sum(weight) AS weight FROM texts JOIN weighed USING (word) GROUP BY label, n
), scores AS (SELECT r, max(CAST(m.weight AS DOUBLE) / CAST(w.weight AS DOUBLE)) AS score FROM matched m JOIN whole w USING (label, n) GROUP BY r
), every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM labelled UNION SELECT r, label FROM hits JOIN base USING (k)) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN base_hits USING (r) LEFT JOIN every USING (r) LEFT JOIN scores USING (r)
"""


SQL = _sql()
