"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds all ordinary pieces of a public ``.model`` file. Text is read once, symbol by
symbol; at each position the output links name all pieces that end there, longest first, and each
relaxes the best score of that position: ``best[i] = max(best[i - len(piece)] + score(piece))``. A
symbol that no piece ends with falls back to its UTF-8 bytes (at a cost below any piece's score),
so every text has an encoding and decoding gives it back exactly. A space is the pieces' mark; a mark
that the text itself holds is spelled in bytes, so the two stay apart.

The file's normaliser is the identity with a leading space mark and spaces escaped; other
normalisers are refused. Pieces hold space marks only at their front, so a text falls apart into
units (marks, then other symbols; a line end stands alone if no piece holds one) that are encoded alone; recurring units are encoded once per
worker. The scores are the model file's; for a file trained by merges they are the merge ranks, so
the result is the best segmentation by rank, not the merge order's.

Defined results: null text gives null tokens, empty text an empty list; texts of any length are
encoded whole; ties go to the longer last piece; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from askwell.llm.common import UnitCache, documents, gathered, slices, text_bytes

MARK = "▁"
# What a symbol of a text is in the pieces: a space is the mark, the text's own mark is in none.
_SYMBOL = {" ": MARK, MARK: ""}
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6  # piece types of the model format (fixed values)


class Pieces:
    """The automaton over a model's pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = [p for p, _, _ in pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == _UNKNOWN), 0)
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == _NORMAL and p]
        if any(MARK in p.lstrip(MARK) for p, _, _ in usable):
            raise ValueError("a piece holds a space mark after other symbols")
        self.lines_apart = not any("\n" in p for p, _, _ in usable)
        self.fallback = min((s for _, s, _ in usable), default=0.0) - 10.0
        self._build(usable)

    def _build(self, usable: list[tuple[str, float, int]]) -> None:
        goto: list[dict[str, int]] = [{}]
        own: list[tuple[int, int, float] | None] = [None]
        for piece, score, i in usable:
            node = 0
            for symbol in piece:
                nxt = goto[node].get(symbol)
                if nxt is None:
                    nxt = goto[node][symbol] = len(goto)
                    goto.append({})
                    own.append(None)
                node = nxt
            own[node] = (len(piece), i, score)
        fail = [0] * len(goto)
        # The pieces that end at a node: its own, then those along its output links.
        ends: list[tuple[tuple[int, int, float], ...]] = [() for _ in goto]
        queue = deque(goto[0].values())
        for node in goto[0].values():
            ends[node] = (own[node],) if own[node] else ()
        while queue:
            node = queue.popleft()
            for symbol, child in goto[node].items():
                back = fail[node]
                while back and symbol not in goto[back]:
                    back = fail[back]
                fail[child] = goto[back].get(symbol, 0)
                ends[child] = ((own[child],) if own[child] else ()) + ends[fail[child]]
                queue.append(child)
        self.goto, self.fail, self.ends = goto, fail, ends

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of the best segmentation of a string (with spaces, not marks)."""
        goto, fail, ends, low = self.goto, self.fail, self.ends, self.fallback
        best, last = [0.0], [(0, 0)]
        node = 0
        for i, symbol in enumerate(unit, 1):
            symbol = _SYMBOL.get(symbol, symbol)
            nxt = goto[node].get(symbol)
            while nxt is None and node:
                node = fail[node]
                nxt = goto[node].get(symbol)
            node = nxt or 0
            top, by = best[-1] + low, (1, -1)
            for size, piece, score in ends[node]:
                got = best[i - size] + score
                if got > top:
                    top, by = got, (size, piece)
            best.append(top)
            last.append(by)
        out: list[int] = []
        at = len(unit)
        while at:
            size, piece = last[at]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids.get(b, self.unknown) for b in reversed(unit[at - 1].encode()))
            at -= size
        out.reverse()
        return out

    def decode(self, ids) -> str:
        """The text of an encoding."""
        return b"".join(map(self.bytes_of, ids)).decode("utf-8", "replace")[1:]

    def bytes_of(self, i: int) -> bytes:
        """What an id stands for: a byte, or a piece with spaces for its marks."""
        return bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(MARK, " ").encode()


def read_model(path: str) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only the identity normaliser with a leading space mark is supported")
    return Pieces([(p.piece, p.score, p.type) for p in proto.pieces])


@lru_cache(maxsize=2)
def model_cache(path: str) -> tuple[Pieces, UnitCache]:
    pieces = read_model(path)
    return pieces, UnitCache(lambda units: [pieces.encode_unit(u) for u in units])


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and how many each has."""
    pieces, cache = model_cache(path)
    data, at = text_bytes(texts)
    full = at[:-1] < at[1:]
    data = np.insert(data, at[:-1][full], 32)  # the leading mark of each text
    at = at + np.concatenate([[0], np.cumsum(full)])
    space = data == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[at[:-1][full]] = True
    if pieces.lines_apart:
        line = np.flatnonzero(data == 10)
        begins[line] = True
        begins[line[line + 1 < len(data)] + 1] = True
    starts = np.flatnonzero(begins)
    ids, sizes = cache.tokens(data, starts, np.append(starts[1:], len(data)))
    total = np.concatenate([[0], np.cumsum(sizes)])
    return ids, np.diff(total[np.searchsorted(starts, at)])


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text")
            ids, counts = encode_texts(text, path)
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(ids, pa.int32()), mask=text.is_null())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens], ["doc_id", "tokens"])

    return encode


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = model_cache(path)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return decode


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tokens (ids of the whole text)."""
    return documents(docs, "doc_id", "text").mapInArrow(_encoder(path), f"doc_id {_kind(docs)}, tokens array<int>")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text."""
    return documents(tokens, "doc_id", "tokens").mapInArrow(_decoder(path), f"doc_id {_kind(tokens)}, text string")


def _kind(frame: DataFrame) -> str:
    return dict(frame.dtypes).get("doc_id", "string")


def encoding_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_bytes_fallback, ids_crc32, round_trip (decoding gives the text back)."""
    import zlib

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = model_cache(path)
        is_byte = np.zeros(len(pieces.pieces), np.int64)
        is_byte[list(pieces.byte_of)] = 1
        # Decoding by table: the bytes of every id, cut out of one long run.
        raw = [pieces.bytes_of(i) for i in range(len(pieces.pieces))]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(raw), np.uint8)
        for batch in slices(batches):
            texts = batch.column("text").fill_null("").to_pylist()
            ids, counts = encode_texts(batch.column("text"), path)
            cut = np.concatenate([[0], np.cumsum(counts)])
            n = sizes[ids]
            ends = np.concatenate([[0], np.cumsum(n)])
            back = gathered(pool, begin[ids], n).tobytes()
            at = ends[cut].tolist()
            same = [back[a:b].decode("utf-8", "replace")[1:] == t for a, b, t in zip(at, at[1:], texts)]
            fallen = np.diff(np.concatenate([[0], np.cumsum(is_byte[ids])])[cut])
            four = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(four[4 * a : 4 * b]) for a, b in zip(cut.tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_chars": pa.array(map(len, texts), pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                    "n_byte_tokens": pa.array(fallen, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same),
                }
            )

    schema = f"doc_id {_kind(docs)}, n_chars long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean"
    return documents(docs, "doc_id", "text").mapInArrow(report, schema)
