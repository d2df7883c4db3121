"""SentencePiece encoding and decoding by exact backtracking.

A merge-type (BPE) model joins, again and again, the adjacent pair whose joined piece scores
best, the leftmost of equals.  The result is the one sequence of pieces in which every two
neighbours are compatible: re-merging both, in the order of scores, never prefers a piece
across their border.  So a text is read from the left: at a position the longest piece that
starts there (Aho-Corasick, one pass over the reversed text with reversed pieces) is tried,
then ever shorter prefixes of it; a piece that is incompatible with its left neighbour, or
that ends where the rest is known to fail, is not taken; where none is left, the position is
marked in a bitfield, the last piece is taken back and its next shorter prefix is tried.
A position that has failed once can never be a border, so the work is linear.

Two bytes that stand side by side in no piece have a border between them in every encoding (such
as white space after a letter, or digits in this vocabulary); between these borders a text is
encoded run by run, and a batch encodes each distinct run once.

The model file is read on the driver and its pieces (some 32,000, checked against MOST_PIECES)
travel inside the functions, so executors need no file.

Defined cases: a null or empty text has no pieces (the end id alone, where it is asked for) and
decodes to an empty text; characters without a piece become byte pieces; U+2581 is white space,
as in the library, so it decodes to a space; repeated rows are encoded one by one; a very long
text is encoded whole; null ids decode to an empty text; other columns pass through, one that
has the name of the result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import small_batches

SPACE = "▁"
MARK = SPACE.encode()
#: The vocabulary travels with the functions; larger ones are refused.
MOST_PIECES = 1 << 20
SLICE_BYTES = 8_000_000
#: Distinct runs (up to KEPT_BYTES) and pairs of pieces whose results a worker keeps; it starts anew beyond.
KEPT_RUNS, KEPT_PAIRS = 400_000, 400_000
KEPT_BYTES = 64


class Vocabulary:
    """Pieces, scores and kinds of a merge-type model, by id; kinds: n(ormal), b(yte), c(ontrol), u(nknown)."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: str, unknown_surface: str, end: int, prefix_space: bool):
        self.pieces, self.scores, self.kinds = pieces, scores, kinds
        self.unknown_surface, self.end, self.prefix_space = unknown_surface, end, prefix_space
        self.key = hashlib.sha256(repr((pieces, scores, kinds, unknown_surface, end, prefix_space)).encode()).hexdigest()


def read_vocabulary(path: str) -> Vocabulary:
    """The model file at ``path``; one whose rules this operator does not follow is refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    kinds = {1: "n", 2: "u", 3: "c", 6: "b"}
    n = m.normalizer_spec
    if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: not a merge-type model with plain normalisation")
    if len(m.pieces) > MOST_PIECES or any(p.type not in kinds for p in m.pieces):
        raise ValueError(f"{path}: too many pieces, or pieces of other kinds than normal, byte, control and unknown")
    if sum(p.type == 6 for p in m.pieces) != 256:
        raise ValueError(f"{path}: no byte pieces")
    return Vocabulary([p.piece for p in m.pieces], [p.score for p in m.pieces], "".join(kinds[p.type] for p in m.pieces), m.trainer_spec.unk_surface, m.trainer_spec.eos_id, n.add_dummy_prefix)


class Encoder:
    """Encodes runs of text; one a worker and vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        for i, (p, s, k) in enumerate(zip(v.pieces, v.scores, v.kinds, strict=True)):
            if k == "n":
                self.score[p], self.id[p] = s, i
            elif k == "b":
                self.byte[int(p[3:5], 16)] = i
        # a character that stands in longer pieces but is none itself starts as a symbol too
        starts = set(self.score) | {c for p in self.score for c in p}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in starts), "") for p in starts}
        self.ac = ahocorasick.Automaton()
        for p in starts:
            self.ac.add_word(p[::-1], p)
        self.ac.make_automaton()
        #: border[x, y]: no piece holds byte y after byte x, and y begins a character, so every encoding has a border there.
        self.border = np.ones((256, 256), bool)
        self.border[:, 0x80:0xC0] = False
        for p in self.score:
            x = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            self.border[x[:-1], x[1:]] = False
        self.border = self.border.reshape(-1)
        self._history: dict[str, tuple] = {}
        self._fits: dict[str, dict[str, str]] = {}
        self._kept = 0
        self._runs: dict[bytes, tuple[int, ...]] = {}

    def history(self, piece: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether merging the piece's characters gives the piece, and its merges in order: (score, first symbol, last symbol after it)."""
        got = self._history.get(piece)
        if got is None:
            symbols, steps = list(piece), [(0.0, piece[0], piece[-1])]
            while len(symbols) > 1:
                best, at = None, -1
                for i in range(len(symbols) - 1):
                    s = self.score.get(symbols[i] + symbols[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                steps.append((best, symbols[0], symbols[-1]))
            got = self._history[piece] = (len(symbols) == 1, steps)
        return got

    def compatible(self, a: str, b: str) -> bool:
        """Whether re-merging a and b side by side leaves the border between them: of the next merges of a, across the border
        and of b the best score goes first, the left one of equals."""
        left, right = self.history(a)[1], self.history(b)[1]
        i = j = 0
        while True:
            across = self.score.get(left[i][2] + right[j][1])
            own = left[i + 1][0] if i + 1 < len(left) else None
            other = right[j + 1][0] if j + 1 < len(right) else None
            if across is not None and (own is None or across > own) and (other is None or across >= other):
                return False
            if own is not None and (other is None or own >= other):
                i += 1
            elif other is not None:
                j += 1
            else:
                return True

    def fitting(self, last: str, piece: str) -> str:
        """The longest of piece and its prefixes that merges from its characters and is compatible with the piece before it ("": none is
        there); "" if there is none.  Pairs are checked once while they are kept."""
        row = self._fits.get(last)
        if row is None:
            row = self._fits[last] = {}
        got = row.get(piece)
        if got is None:
            got = piece
            while got and not (self.history(got)[0] and (not last or self.compatible(last, got))):
                got = self.shorter.get(got, "")
            if self._kept >= KEPT_PAIRS:
                self._fits.clear()
                self._kept = 0
            self._kept += 1
            row[piece] = got
        return got

    def split(self, text: str) -> list[str]:
        """The pieces of a text whose white space is written as U+2581."""
        n = len(text)
        # the automaton reports the pieces that end at a place of the reversed text longest first; of equal keys the last stays
        longest = dict(reversed(list(self.ac.iter(text[::-1]))))
        fits = self._fits
        failed = bytearray(n + 1)
        out: list[str] = []
        at, piece, last = 0, longest.get(n - 1) or text[:1], ""
        while at < n:
            row = fits.get(last)
            got = row.get(piece) if row is not None else None
            if got is None:
                got = self.fitting(last, piece)
            while got and failed[at + len(got)]:
                got = self.fitting(last, self.shorter.get(got, ""))
            if got:
                out.append(got)
                at += len(got)
                last, piece = got, longest.get(n - 1 - at) or text[at : at + 1]
            else:
                if not last:
                    raise ValueError("a text without an encoding")
                failed[at] = 1
                piece = self.shorter.get(out.pop(), "")
                at -= len(last)
                last = out[-1] if out else ""
        return out

    def run_ids(self, run: bytes) -> tuple[int, ...]:
        got = self._runs.get(run)
        if got is None:
            text = run.decode().replace(" ", SPACE)
            whole = self.id.get(text)
            pieces = [text] if whole is not None and self.history(text)[0] else self.split(text)
            found = [self.id.get(p) for p in pieces]
            if None in found:
                found = [i for p, i in zip(pieces, found, strict=True) for i in ((i,) if i is not None else [self.byte[x] for x in p.encode()])]
            if len(self._runs) >= KEPT_RUNS:
                self._runs.clear()
            got = tuple(found)
            if len(run) <= KEPT_BYTES:
                self._runs[run] = got
        return got

    def slice_ids(self, data: np.ndarray, offsets: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a slice of texts."""
        texts = len(offsets) - 1
        raw = data.tobytes()
        if MARK in raw:
            each = [raw[a:b].replace(MARK, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
            data = np.frombuffer(b"".join(each), np.uint8)
        full = np.diff(offsets) > 0
        if self.v.prefix_space:
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        edge[n] = False
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        edge[1:n] |= self.border[pair]
        start = np.flatnonzero(edge)
        bounds = np.append(start, n).astype(np.int64)
        first = np.searchsorted(start, offsets)
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids = [self.run_ids(x) for x in runs.dictionary.to_pylist()]
        codes = runs.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        each = size[codes]
        done = np.concatenate([[0], np.cumsum(each)])
        got = flat[np.repeat(begin[codes] - done[:-1], each) + np.arange(done[-1])]
        count = np.diff(done[first])
        if end:
            got = np.insert(got, np.cumsum(count), self.v.end)
            count = count + 1
        return got.astype(np.int32), count if texts else np.zeros(0, np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(v: Vocabulary) -> Encoder:
    if v.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[v.key] = Encoder(v)
    return _ENCODERS[v.key]


def encode_texts(v: Vocabulary, texts: pa.Array, end: bool) -> pa.Array:
    """An array of ids for each text."""
    enc, ids, count = encoder(v), [], []
    for _, _, data, offsets in tk.slices(tk.column(pa.record_batch([texts], ["t"]), "t"), SLICE_BYTES):
        i, c = enc.slice_ids(data, offsets, end)
        ids.append(i)
        count.append(c)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(count))]) if count else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))


def mended(raw: bytes) -> bytes:
    """The bytes of byte pieces, each that belongs to no whole character replaced by U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                raw[at : at + width].decode()
            except UnicodeDecodeError:
                continue
            out.append(raw[at : at + width])
            at += width
            break
        else:
            out.append(b"\xef\xbf\xbd")
            at += 1
    return b"".join(out)


class Decoder:
    """Joins pieces: what each id writes stands in one table, from which a batch is gathered."""

    def __init__(self, v: Vocabulary):
        self.v = v
        writes = {"n": lambda p: p.replace(SPACE, " ").encode(), "b": lambda p: bytes([int(p[3:5], 16)]), "c": lambda p: b"", "u": lambda p: v.unknown_surface.encode()}
        self.writes = pa.array([writes[k](p) for p, k in zip(v.pieces, v.kinds, strict=True)], pa.large_binary())
        self.byte = np.array([k == "b" for k in v.kinds])
        self.silent = np.array([k == "c" for k in v.kinds])
        #: Pieces that begin with white space, one of which goes where it is the first thing written.
        self.leading = np.array([k == "n" and p.startswith(SPACE) for p, k in zip(v.pieces, v.kinds, strict=True)])

    def text(self, ids: np.ndarray, raw: bytes) -> str:
        """The text of one row; raw: what its ids write."""
        try:
            text = raw.decode() if not self.silent[ids[:-1]].any() else self.by_runs(ids).decode()
        except UnicodeDecodeError:
            text = self.by_runs(ids).decode()
        if self.v.prefix_space and len(ids):
            heard = np.flatnonzero(~self.silent[ids])
            if len(heard) and self.leading[ids[heard[0]]]:
                return text[1:]
        return text

    def by_runs(self, ids: np.ndarray) -> bytes:
        out, i = [], 0
        while i < len(ids):
            j = i
            while j < len(ids) and self.byte[ids[j]]:
                j += 1
            if j > i:
                out.append(mended(b"".join(self.writes[int(x)].as_py() for x in ids[i:j])))
                i = j
            else:
                out.append(self.writes[int(ids[i])].as_py())
                i += 1
        return b"".join(out)


_DECODERS: dict[str, Decoder] = {}


def decode_ids(v: Vocabulary, ids: pa.Array) -> pa.Array:
    """The text of each array of ids."""
    if v.key not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[v.key] = Decoder(v)
    d = _DECODERS[v.key]
    ids = ids.cast(pa.large_list(pa.int32()))
    out = []
    bounds = ids.offsets.to_numpy()
    values = ids.values.to_numpy(zero_copy_only=False)
    at, n = 0, len(ids)
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES // 4, "right")) - 1))
        some = values[bounds[at] : bounds[to]]
        written = d.writes.take(pa.array(some))
        where = np.frombuffer(written.buffers()[1], np.int64)[: len(some) + 1] if len(some) else np.zeros(1, np.int64)
        raw = (written.buffers()[2] or pa.py_buffer(b"")).to_pybytes() if len(some) else b""
        local = bounds[at : to + 1] - bounds[at]
        out += [d.text(some[a:b], raw[where[a] : where[b]]) for a, b in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)]
        at = to
    return pa.array(out, pa.string())


def with_ids(docs: DataFrame, v: Vocabulary, text: str = "text", into: str = "piece_ids", end: bool = True) -> DataFrame:
    """docs with the ids of each whole text, the end id last if asked for."""
    small_batches(docs)
    # declared not deterministic, so that no plan encodes again for each use of the ids
    encode = F.arrow_udf(lambda t: encode_texts(v, t, end), "array<int>").asNondeterministic()
    return docs.withColumn(into, encode(F.col(f"`{text}`")))


def with_text(ids: DataFrame, v: Vocabulary, of: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """ids with the text that each array of ids stands for."""
    small_batches(ids)
    decode = F.arrow_udf(lambda x: decode_ids(v, x), "string")
    return ids.withColumn(into, decode(F.col(f"`{of}`")))


def digest(values: Column) -> Column:
    return F.sha2(F.encode(values, "UTF-8"), 256)


def query(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""
    v = read_vocabulary(path)
    done = with_text(with_ids(docs.select("doc_id", "text"), v), v)
    return done.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("piece_ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
