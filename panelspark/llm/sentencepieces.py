"""Exact ids of a SentencePiece merge model, and the text of ids.

Encoding is not by merging the text step by step.  A sequence of pieces is what merging gives exactly if every two
neighbours, merged alone from their characters, come out as these two pieces again; so the sequence can be searched for from
the left.  An Aho-Corasick automaton of all pieces lists the pieces that begin at each place.  The search takes the longest
one that is compatible with the piece before it, tries shorter ones where it is not, steps back where none is left, and
keeps a bitfield of the places from which it had to step back: no piece that ends there is tried again.  Compatibility is
found by re-merging the two pieces and remembered.

No merge crosses two characters that stand side by side in no piece, so texts are cut at such places (in practice before
most spaces) into units.  A worker encodes a unit once, remembers its ids by the 64-bit hash of its bytes, and a slice of
many texts is put together from that table with array operations.  The table starts anew when it is full; that changes the
time, not the result.

A text that is null counts as empty; an empty text has only begin and end ids.  A character without a piece becomes the
pieces of its bytes, or the unknown piece where the model has none.  Very long texts are one row; their units are what is
held.
"""
from __future__ import annotations

import codecs
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelspark.llm.common import bound_batches, chunks, text_buffer
from panelspark.llm.tokens import UnitEncoder

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: With more remembered pairs than this a worker starts anew; the number of units is UnitEncoder's.
PAIRS = 1_000_000


class Model:
    """Pieces, scores and flags of a model file; only merge models without text normalisation are supported."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if (model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces
                or model.trainer_spec.treat_whitespace_as_suffix or kinds & {USER, UNUSED}):
            raise ValueError(f"{path}: only merge models with an identity normaliser and without user-defined or unused pieces are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE} if model.trainer_spec.byte_fallback else {}
        surface = [self._surface(p, model.trainer_spec.unk_surface) for p in model.pieces]
        self.length = np.array([len(s) for s in surface], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(surface), np.uint8)

    @staticmethod
    def _surface(piece, unknown: str) -> bytes:
        """Bytes of a piece in decoded text."""
        if piece.type == CONTROL:
            return b""
        if piece.type == UNKNOWN:
            return unknown.encode()
        return bytes([int(piece.piece[3:5], 16)]) if piece.type == BYTE else piece.piece.replace(SPACE, " ").encode()


class BacktrackEncoder:
    """Ids of one unit; compatibility of pairs is remembered."""

    def __init__(self, model: Model):
        import ahocorasick
        self.model = model
        self.pieces = ahocorasick.Automaton()
        for piece in model.ids:
            self.pieces.add_word(piece, len(piece))
        self.pieces.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, the left-most of equal ones, until none make a piece."""
        parts, score = list(text), self.model.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit; a character without a piece stands alone."""
        if unit in self.model.ids and self.compatible("", unit):
            return [unit]
        n = len(unit)
        sizes: list[list[int]] = [[] for _ in range(n + 1)]  # lengths of the pieces that begin at a place, ascending
        for end, size in self.pieces.iter(unit):
            sizes[end + 1 - size].append(size)
        for s in sizes[:n]:
            s.sort()
            if not s or s[0] > 1:
                s.insert(0, 1)
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        tried: list[int] = []  # for each piece of `out`, which of its place's lengths it has
        pos, choice = 0, len(sizes[0]) - 1
        while pos < n:
            before = out[-1] if out else ""
            while choice >= 0:
                end = pos + sizes[pos][choice]
                if not failed[end >> 3] >> (end & 7) & 1 and self.compatible(before, unit[pos:end]):
                    break
                choice -= 1
            if choice >= 0:
                out.append(unit[pos:end])
                tried.append(choice)
                pos, choice = end, len(sizes[end]) - 1
            else:  # raises where no sequence exists, which merging rules out
                failed[pos >> 3] |= 1 << (pos & 7)
                pos, choice = pos - len(out.pop()), tried.pop() - 1
        return out

    def encode(self, unit: str) -> list[int]:
        ids, out = self.model.ids, []
        for p in self.split(unit):
            if p in ids:
                out.append(ids[p])
            elif self.model.byte_id:
                out.extend(self.model.byte_id[b] for b in p.encode())
            else:
                out.append(self.model.unknown)
        return out


class PieceEncoder(UnitEncoder):
    """encode(column) gives the ids of many texts at once; see UnitEncoder."""

    spaced = True

    def __init__(self, path: str):
        self.model = Model(path)
        self.search = BacktrackEncoder(self.model)
        side = np.zeros((129, 129), bool)  # byte classes: an ASCII byte each, 128 for all others
        side[128, 128] = True
        for piece in self.model.ids:
            c = [min(ord(x), 128) for x in piece.replace(SPACE, " ")]
            side[c[:-1], c[1:]] = True
        self.apart = ~side
        self._reset()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.search.encode(t.replace(" ", SPACE)) for t in texts]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = np.minimum(data, 128)
        begin = np.zeros(len(data) + 1, bool)
        begin[offs] = True
        begin[1:-1] |= self.apart[kind[:-1], kind[1:]]
        starts = np.flatnonzero(begin[:-1])
        return starts, np.append(starts[1:], len(data))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE, " ")
        if self.model.dummy_prefix:
            text = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
        return self._by_units(*text_buffer(text))

    def with_ends(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end ids around each text."""
        n = np.diff(ends) + 2
        at = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(at[-1], np.uint32)
        out[at[:-1]], out[at[1:] - 1] = self.model.begin, self.model.end
        out[np.arange(len(flat)) + 2 * np.repeat(np.arange(len(n)), n - 2) + 1] = flat
        return out, at


def decoded(model: Model, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """UTF-8 text of each range of ids: begin and end ids are silent, the space that encoding put before the text goes, and
    bytes that are no UTF-8 become one replacement character each."""
    size = model.length[flat]
    total = np.concatenate([[0], np.cumsum(size)])
    raw = model.data[np.repeat(model.start[flat] - total[:-1], size) + np.arange(total[-1])]
    lo, hi = total[ends[:-1]], total[ends[1:]]
    if model.dummy_prefix and len(raw):
        owner = np.searchsorted(total, lo, "right") - 1  # first piece that is not silent
        inside = lo < hi
        by_byte = np.isin(flat[np.minimum(owner, len(flat) - 1)], list(model.byte_id.values()) + [model.unknown])
        lo = lo + (inside & ~by_byte & (raw[np.minimum(lo, len(raw) - 1)] == 32))
    out, breaks = raw.tobytes(), total[np.flatnonzero(size == 0)]  # a silent piece parts the bytes around it

    def text(a: int, b: int) -> bytes:
        inner = breaks[np.searchsorted(breaks, a, "right"):np.searchsorted(breaks, b)].tolist()
        return "".join(out[x:y].decode("utf-8", "each-byte") for x, y in zip([a, *inner], [*inner, b])).encode()
    return [text(a, b) for a, b in zip(lo.tolist(), hi.tolist())]


codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with begin and end ids, for every row."""
    def run(batches):
        enc = encoder(path)
        for b in chunks(batches, "text"):
            flat, at = enc.with_ends(*enc.encode(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))], names=["doc_id", "ids"])
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with (doc_id, ids); null ids give null."""
    def run(batches):
        model = encoder(path).model
        for b in batches:
            ids = b.column("ids").combine_chunks() if isinstance(b.column("ids"), pa.ChunkedArray) else b.column("ids")
            sizes = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            text = decoded(model, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.decode() for t in text], pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "text"])
    bound_batches(rows.sparkSession)
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, decoded again, both digested in one pass."""
    def run(batches):
        enc = encoder(path)
        for b in chunks(batches, "text"):
            flat, at = enc.with_ends(*enc.encode(b.column("text")))
            raw, cuts = flat.astype("<u4").tobytes(), (at * 4).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(cuts, cuts[1:])], pa.string()),
                                              pa.array([hashlib.sha256(t).hexdigest() for t in decoded(enc.model, flat, at)], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
