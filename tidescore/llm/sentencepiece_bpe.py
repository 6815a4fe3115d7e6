"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose join is in the vocabulary, ordered by score, then by place. The
best pair is joined, the pairs at its two ends enter the agenda, and entries whose symbols have changed since are skipped.
A symbol that is not in the vocabulary becomes its UTF-8 bytes' pieces.

No join crosses a place between two characters that stand side by side in no piece. Texts are cut there first, which
changes no result: between ASCII characters, before spaces and around line ends by arrays of a batch's bytes, then elsewhere. The batch's
distinct cuts are looked up in a cache, bounded in bytes, of the ids of cuts seen before, and their ids laid out by arrays.

Every Arrow batch is checked against the sentencepiece library's own encoding of its texts; any difference raises.

Defined cases: null text is empty and has no ids; repeated rows and null ids of rows are kept as they are; extra columns
are ignored; the model's bytes travel with the plan (a vocabulary file, bounded by its vocabulary).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_format

from tidescore.llm import common

SPACE = "▁"
NORMAL = 1
#: Cuts that a worker's cache holds, and bytes of them and their ids, before it starts anew.
CACHE_CUTS, CACHE_BYTES = 300_000, 56_000_000
#: Characters of the texts whose ids stand as lists at once, but for one longer text.
PART_CHARS = 500_000
#: Bytes that a cut takes beyond its characters and ids, and characters beyond which one is not kept.
CUT_BYTES, LONG_CUT = 200, 64
#: Characters up to which the agenda is a plain list.
SHORT = 40
#: Characters up to which the cuts of a batch are encoded together.
TOGETHER = 32
#: Code points whose pairs have a table of their own.
DENSE = 384
#: Symbols as numbers: a piece's id, or the number of pieces and the code point of a character that is no piece.
NUMBER_BITS = 24
NUMBER_MASK, NO_PAIR = (1 << NUMBER_BITS) - 1, 1 << 62

_coders: dict[bytes, "Coder"] = {}


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Numbers(dict):
    """Numbers by character."""

    def __init__(self, ids: dict[str, int], size: int):
        super().__init__((c, i) for c, i in ids.items() if len(c) == 1)
        self.size = size

    def __missing__(self, c: str) -> int:
        return self.size + ord(c)


class _Ids(dict):
    """Ids by cut, packed in bytes; what is missing is encoded. The cache starts anew when it is full; long cuts are not kept."""

    def __init__(self, find, most: int, most_bytes: int):
        self.find, self.most, self.most_bytes, self.bytes = find, most, most_bytes, 0

    def __missing__(self, cut):
        ids = self.find(cut)
        if len(cut) <= LONG_CUT:
            self.room(1, CUT_BYTES + len(cut) + len(ids))
            self[cut] = ids
        return ids

    def take(self, found: dict) -> None:
        """Keeps what was found together, or as much of it as there is room for in an empty cache."""
        size = sum(map(len, found)) + sum(map(len, found.values())) + CUT_BYTES * len(found)
        share = min(1.0, self.most / max(1, len(found)), self.most_bytes / max(1, size))
        if share < 1:
            found = dict(itertools.islice(found.items(), int(share * len(found))))
            size = sum(map(len, found)) + sum(map(len, found.values())) + CUT_BYTES * len(found)
        self.room(len(found), size)
        self.update(found)

    def room(self, cuts: int, size: int) -> None:
        if len(self) + cuts > self.most or self.bytes + size > self.most_bytes:
            self.clear()
            self.bytes = 0
        self.bytes += size


class Coder:
    def __init__(self, model: bytes, cache: int = CACHE_CUTS, cache_bytes: int = CACHE_BYTES):
        proto = model_format.ModelProto()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte fallback is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser with a leading space is supported")
        if {p.type for p in proto.pieces} & {4, 5}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.costs = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.side_by_side = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(p[0] != SPACE and p[1] == SPACE for p in self.side_by_side) or any("\n" in p for p in self.ids):
            raise ValueError("pieces that hold a space after other text, or a line end, are not supported")
        ascii_ = [SPACE if b == 32 else chr(b) for b in range(128)]
        apart = np.zeros((256, 256), bool)  # of two ASCII characters; others are cut later
        apart[:128, :128] = [[x + y not in self.side_by_side for y in ascii_] for x in ascii_]
        apart[10, 128:] = apart[128:, 10] = apart[128:, 32] = True  # line ends, and spaces after other text
        self.apart = apart.ravel()
        self.size = len(proto.pieces)
        self.numbers = _Numbers(self.ids, self.size)
        order = {c: k for k, c in enumerate(sorted(set(self.costs.values())))}
        self.joins = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                ends = [self.ids.get(x) if len(x) > 1 else self.numbers[x] for x in (piece[:k], piece[k:])]
                if None not in ends:
                    self.joins[ends[0] << NUMBER_BITS | ends[1]] = order[self.costs[piece]] << NUMBER_BITS | i
        self.join_keys = np.array(sorted(self.joins), np.int64)
        self.join_entries = np.array([self.joins[k] for k in self.join_keys.tolist()], np.int64)
        self.number_table = np.arange(0x110000, dtype=np.int64) + self.size
        for c, i in self.numbers.items():
            self.number_table[ord(c)] = i
        near = [SPACE, *map(chr, range(DENSE))]
        self.dense = np.array([[self.joins.get(self.numbers[a] << NUMBER_BITS | self.numbers[b], NO_PAIR) for b in near] for a in near], np.int64)
        single = [c for p, c in self.costs.items() if len(p) > 1 and p.strip(SPACE)]
        self.distinct_scores = len(set(single)) == len(single)
        self.line_end = pack([self.bytes[10]])
        self.parts = _Ids(self.agenda, cache // 4, cache_bytes // 4)
        self.cuts = _Ids(lambda cut: self.cut(cut.decode().replace(" ", SPACE)), cache, cache_bytes * 3 // 4)
        self.cuts[b"\n"] = self.line_end

    def agenda(self, text: str) -> bytes:
        """Ids of a text, white space escaped, by joining the best pair of neighbours until none is left."""
        n = len(text)
        costs = self.costs
        symbols: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []
        for i in range(n - 1):
            joined = text[i : i + 2]
            if joined in costs:
                waiting.append((costs[joined], i, i + 1, joined))
        heapq.heapify(waiting)
        while waiting:
            _, left, right, joined = heapq.heappop(waiting)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != len(joined):
                continue
            symbols[left], symbols[right] = joined, None
            follows = after[left] = after[right]
            if follows < n:
                before[follows] = left
                longer = joined + symbols[follows]
                if longer in costs:
                    heapq.heappush(waiting, (costs[longer], left, follows, longer))
            leads = before[left]
            if leads >= 0:
                longer = symbols[leads] + joined
                if longer in costs:
                    heapq.heappush(waiting, (costs[longer], leads, left, longer))
        return self.pieces([x for x in symbols if x is not None])

    def short(self, text: str) -> bytes:
        """agenda() for a short text without runs of spaces, in numbers.

        The agenda is a list with the entry of each pair in place: the place of the joined piece in the order of scores, then
        its id. Its least entry is the best pair; no two pieces share a score here, so equal entries differ in place only.
        """
        join = self.joins.get
        symbols = list(map(self.numbers.__getitem__, text))
        waiting = [join(a << NUMBER_BITS | b, NO_PAIR) for a, b in zip(symbols, symbols[1:])]
        while waiting and (least := min(waiting)) != NO_PAIR:
            i = waiting.index(least)
            joined = symbols[i] = least & NUMBER_MASK
            del symbols[i + 1]
            del waiting[i]
            if i < len(waiting):
                waiting[i] = join(joined << NUMBER_BITS | symbols[i + 1], NO_PAIR)
            if i:
                waiting[i - 1] = join(symbols[i - 1] << NUMBER_BITS | joined, NO_PAIR)
        return pack(symbols if max(symbols) < self.size else self.spelled(symbols))

    def spelled(self, symbols: list[int]) -> list[int]:
        """Numbers, those beyond the vocabulary as their bytes' pieces."""
        return [i for x in symbols for i in ((x,) if x < self.size else map(self.bytes.__getitem__, chr(x - self.size).encode()))]

    def pieces(self, symbols: list[str]) -> bytes:
        """Ids of symbols; those that are no piece become their bytes' pieces."""
        return pack([i for x in symbols for i in ((self.ids[x],) if x in self.ids else map(self.bytes.__getitem__, x.encode()))])

    def cut(self, text: str) -> bytes:
        """Ids of a text, which is cut between characters that no piece holds side by side."""
        if len(text) <= SHORT and self.distinct_scores and SPACE not in text[1:]:
            return self.short(text)
        pairs = self.side_by_side
        ends = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs]
        if not ends:
            return self.agenda(text)
        return b"".join(map(self.parts.__getitem__, map(text.__getitem__, map(slice, [0, *ends], [*ends, len(text)]))))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        ids, edges = self.encode_flat(texts)
        return [ids[s:e].tolist() for s, e in itertools.pairwise(edges.tolist())]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's start and the last one's end). Cuts that are not in the cache are encoded together first."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        raw = [(" " + t.replace(SPACE, " ")).encode() if t else b"" for t in texts]
        starts, ends = boundaries(raw, self.apart)
        data = pa.py_buffer(b"".join(raw))
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), data]).dictionary_encode()
        distinct, which = column.dictionary.to_pylist(), column.indices.to_numpy()
        cuts = dict.fromkeys(distinct)
        cuts.update((w, dict.__getitem__(self.cuts, w)) for w in cuts.keys() & self.cuts.keys())
        if self.distinct_scores:
            cuts.update(self.learn([w for w, ids in cuts.items() if ids is None and len(w) <= LONG_CUT and b"  " not in w and b"\0" not in w]))
        known = [self.cuts[w] if ids is None else ids for w, ids in cuts.items()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        places = np.concatenate([[0], np.cumsum(sizes)])
        count = sizes[which]
        after = np.concatenate([[0], np.cumsum(count)])
        ids = np.frombuffer(b"".join(known), np.int32)[np.arange(after[-1]) + np.repeat(places[which] - after[:-1], count)]
        return ids, np.concatenate([[0], after[ends]])

    def learn(self, cuts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of those cuts that are short, put into the cache: the agenda of short(), for all cuts of like length at once."""
        by_length: dict[int, list[str]] = {}
        for w in map(bytes.decode, cuts):
            if len(w) <= TOGETHER:
                by_length.setdefault(len(w), []).append(w)
        found: dict[bytes, bytes] = {}

        def keep(words, symbols: np.ndarray) -> None:
            if (symbols >= self.size).any():
                ids = [pack(self.spelled(row)) for row in symbols.tolist()]
            else:
                packed, step = symbols.astype(np.int32).tobytes(), 4 * symbols.shape[1]
                ids = [packed[k : k + step] for k in range(0, len(packed), step)]
            found.update(zip(map(str.encode, words), ids, strict=True))

        for length, some in by_length.items():
            points = np.array(some, f"U{length}").view(np.uint32).reshape(len(some), length)
            points[points == 32] = ord(SPACE)
            symbols = self.number_table[points]
            place = np.where(points == ord(SPACE), 0, np.minimum(points, DENSE - 1) + 1)  # of a character in the dense table
            waiting = self.dense[place[:, :-1], place[:, 1:]]
            far = (points >= DENSE) & (points != ord(SPACE))
            far = far[:, 1:] | far[:, :-1]
            if far.any():
                waiting[far] = self.entries(symbols[:, :-1][far], symbols[:, 1:][far])
            at, rows = np.arange(len(some)), np.arange(len(some))
            while len(at):  # every word left has had as many joins, so all have as many symbols
                if waiting.shape[1]:
                    i = waiting.argmin(axis=1)
                    least = waiting[rows, i]
                    go = least != NO_PAIR
                else:
                    go = np.zeros(len(at), bool)
                if not go.all():
                    keep(map(some.__getitem__, at[~go].tolist()), symbols[~go])
                    if not go.any():
                        break
                    at, symbols, waiting, i, least = at[go], symbols[go], waiting[go], i[go], least[go]
                    rows = rows[: len(at)]
                symbols[rows, i] = least & NUMBER_MASK
                keep_symbol = np.ones(symbols.shape, bool)
                keep_symbol[rows, i + 1] = False
                symbols = symbols[keep_symbol].reshape(len(at), -1)
                keep_pair = np.ones(waiting.shape, bool)
                keep_pair[rows, i] = False
                waiting = waiting[keep_pair].reshape(len(at), -1)
                after = np.flatnonzero(i < waiting.shape[1])
                waiting[after, i[after]] = self.entries(symbols[after, i[after]], symbols[after, i[after] + 1])
                before = np.flatnonzero(i > 0)
                waiting[before, i[before] - 1] = self.entries(symbols[before, i[before] - 1], symbols[before, i[before]])
        self.cuts.take(found)
        return found

    def entries(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Agenda entries of pairs of numbers; NO_PAIR where they join to no piece."""
        key = a << NUMBER_BITS | b
        place = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where(self.join_keys[place] == key, self.join_entries[place], NO_PAIR)


def boundaries(raw: list[bytes], apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the cuts of joined texts and the end; of each text, the number of cuts up to its end).

    apart: for every two bytes, whether texts are cut between them.
    """
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(raw), np.uint8)
    begins = np.zeros(len(text), bool)
    if len(text):
        begins[1:] = apart[text[:-1].astype(np.uint16) << 8 | text[1:]]
    begins[(ends - sizes)[sizes > 0]] = True
    starts = np.append(np.flatnonzero(begins), len(text)).astype(np.int64)
    return starts, np.searchsorted(starts, ends)


def coder(model: bytes) -> Coder:
    """This worker's coder for a model, with its cache."""
    if model not in _coders:
        _coders[model] = Coder(model)
    return _coders[model]


def checked(own: Coder, texts: list[str]) -> Iterator[tuple[list[str], list[list[int]]]]:
    """The texts and their ids in parts of PART_CHARS, after a comparison with the library's ids of every text."""
    ids, edges = own.encode_flat(texts)
    parts = np.cumsum([len(t) for t in texts], dtype=np.int64) // PART_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
    for s, e in itertools.pairwise(cuts):
        theirs = own.library.encode(texts[s:e], num_threads=1)
        for i, found in enumerate(theirs, s):
            if found != ids[edges[i] : edges[i + 1]].tolist():
                raise RuntimeError(f"encoding differs from the library's for a text of {len(texts[i])} characters: {texts[i][:80]!r}")
        yield texts[s:e], theirs


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids and decoded."""
    model = Path(model_path).read_bytes()
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""

    def work(batches):
        own = coder(model)
        digits = [str(i) for i in range(own.library.get_piece_size())]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
        names = list(kinds)[: 5 if with_ids else 3]
        collects = gc.isenabled()
        gc.disable()  # a batch makes many lists and no cycles; looking for some costs a tenth of the time
        try:
            for batch in common.slices(batches, 1):
                columns = {c: [] for c in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
                for _, ids in checked(own, [common.text_of(t) for t in batch.column(1).to_pylist()]):
                    decoded = own.library.decode(ids, num_threads=1) if ids else []
                    columns["n_tokens"] += map(len, ids)
                    columns["ids_sha256"] += [sha(",".join(map(digits.__getitem__, x))) for x in ids]
                    columns["decoded_sha256"] += map(sha, decoded)
                    if with_ids:
                        columns["ids"] += [np.array(x, np.int32) for x in ids]
                        columns["decoded"] += decoded
                arrays = [pa.array(columns[c], kinds[c]) for c in names]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])
        finally:
            if collects:
                gc.enable()

    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def op2_sentencepiece(docs: DataFrame, model_path: str) -> DataFrame:
    return encode(docs, model_path, with_ids=False)
