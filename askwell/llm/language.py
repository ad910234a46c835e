"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of labelled text. A text is parsed against
it greedily: each phrase is the longest match with the labelled text, and a byte that never occurs
there is a phrase of its own. The phrases, times the bits that name a place in the labelled text, per
byte of the text, estimate the cross entropy; the language with the least of them wins. The score is
the lead over the runner-up, 0 to 1.

Texts are lower-cased, all but letters becomes single spaces, and they are cut into stretches of ``STRETCH`` bytes that numpy parses side by side, against
all languages at once, so that a long text takes no longer per byte. A phrase ends with its stretch.

The labelled sample is bounded: ``SAMPLE_ROWS`` rows per language in the order of a hash, and of each a stretch
of ``SAMPLE_CHARS`` characters from a place that a hash picks in the whole text. It is all that reaches the driver and the tasks (40 KB for each
language); everything else is done row by row, without a shuffle. A worker's automata take about 1 MB for each
language, as only moves that exist are held.

Defined results: null text, or text without a letter, is ``und`` with score 0; without labelled rows all
are ``und``; ties go to the first language by code point; repeated rows are judged alike; labels of null
are not learned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.llm.common import documents, slices, text_bytes

SAMPLE_ROWS = 64
SAMPLE_CHARS = 640
STRETCH = 512
UNKNOWN = "und"


class SuffixAutomaton:
    """All substrings of a text: ``moves[state]`` maps a byte to the state of the longer substring."""

    def __init__(self, text: bytes):
        moves: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        last = 0
        for symbol in text:
            new = len(moves)
            moves.append({})
            link.append(0)
            size.append(size[last] + 1)
            at = last
            while at >= 0 and symbol not in moves[at]:
                moves[at][symbol] = new
                at = link[at]
            if at >= 0:
                to = moves[at][symbol]
                if size[to] == size[at] + 1:
                    link[new] = to
                else:
                    copy = len(moves)
                    moves.append(dict(moves[to]))
                    link.append(link[to])
                    size.append(size[at] + 1)
                    while at >= 0 and moves[at].get(symbol) == to:
                        moves[at][symbol] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        self.moves = moves


class Moves:
    """The moves of many automata in one pool of slots: about one slot a move, however wide the alphabet.

    State ``s`` has its move by ``symbol`` in slot ``base[s] + symbol`` if that slot's ``owner`` is ``s``. Rows of several
    moves are laid side by side where all of their slots are free, and single moves fill what is left open.
    """

    def __init__(self, automata: list[list[dict[int, int]]], width: int):
        parts, states, slots = [], 0, 0
        self.roots = []
        for moves in automata:
            base, owner, to = self._laid(moves, width)
            parts.append((base + slots, np.where(owner < 0, -1, owner + states), to + states))
            self.roots.append(states)
            states, slots = states + len(moves), slots + len(owner)
        empty = [(np.zeros(0, np.int32),) * 3]
        self.base, self.owner, self.to = (np.concatenate(x).astype(np.int32) for x in zip(*(parts or empty)))

    @staticmethod
    def _laid(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base of each state; owner and target of each slot."""
        many = sorted((s for s, row in enumerate(moves) if len(row) > 1), key=lambda s: (-len(moves[s]), s))
        taken, base, low = bytearray(2 * width + sum(map(len, moves))), np.zeros(len(moves), np.int64), 0
        for state in many:
            at, tries, row = low, 0, moves[state]
            first, others = min(row), list(row)
            while True:
                for symbol in others:
                    if taken[at + symbol]:
                        break
                else:
                    break
                at, tries = taken.find(0, at + first + 1) - first, tries + 1  # the next place with its first slot open
                if at + 2 * width > len(taken):
                    taken.extend(bytes(len(taken)))
            for symbol in row:
                taken[at + symbol] = 1
            base[state] = at
            if tries > 32:  # what is left open below is for the single moves
                low = max(low, at - width // 2)
        one = np.array([s for s, row in enumerate(moves) if len(row) == 1], np.int64)
        symbols = np.array([next(iter(moves[s])) for s in one.tolist()], np.int64)
        # A base isn't negative, so single moves start beyond the first symbols.
        free = np.flatnonzero(np.frombuffer(bytes(taken) + bytes(len(one) + width), np.uint8)[width:] == 0)[: len(one)] + width
        base[one] = free - symbols
        states = np.repeat(np.arange(len(moves)), [len(row) for row in moves])
        by = np.array([symbol for row in moves for symbol in row], np.int64)
        targets = np.array([to for row in moves for to in row.values()], np.int64)
        slots = base[states] + by
        end = int(max(base.max(initial=0) + width, slots.max(initial=0) + 1))
        owner, to = np.full(end, -1, np.int64), np.zeros(end, np.int64)
        owner[slots], to[slots] = states, targets
        return base, owner, to

    def after(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where there is no move."""
        slots = self.base[states] + symbols
        return np.where(self.owner[slots] == states, self.to[slots], -1)


class CrossParser:
    """Counts phrases of many texts against many languages."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = [samples[name].encode() for name in self.languages]
        symbols = np.unique(np.frombuffer(b"".join(texts), np.uint8))
        self.code = np.full(256, len(symbols), np.int32)  # the last code: in no sample
        self.code[symbols] = np.arange(len(symbols))
        codes = self.code.astype(np.uint8).tobytes()  # UTF-8 never uses all bytes, so that the last code is below 256
        self.moves = Moves([SuffixAutomaton(text.translate(codes)).moves for text in texts], len(symbols) + 1)
        self.roots = self.moves.roots
        self.bits = np.array([np.log2(max(2, len(t))) for t in texts])

    def phrases(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        n, langs = len(at) - 1, len(self.languages)
        per = -(-np.diff(at) // STRETCH)
        owner = np.repeat(np.arange(n), per)
        begin = at[:-1][owner] + STRETCH * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
        size = np.minimum(at[1:][owner] - begin, STRETCH)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        symbols = self.code[data]
        root = np.repeat(np.array(self.roots, np.int32)[:, None], len(begin), axis=1)
        state, count = root.copy(), np.zeros(root.shape, np.int64)
        active = np.searchsorted(-size, -np.arange(STRETCH), "left")  # stretches longer than each step
        for step in range(int(size[0]) if len(size) else 0):
            k = int(active[step])
            symbol, top = symbols[begin[:k] + step], root[:, :k]
            now = state[:, :k]
            to = self.moves.after(now, symbol)
            miss = to < 0
            if miss.any():
                ended = miss & (now != top)
                again = self.moves.after(top, symbol)
                alone = miss & (again < 0)
                count[:, :k] += ended
                count[:, :k] += alone
                to = np.where(miss, np.where(alone, top, again), to)
            state[:, :k] = to
        count += state != root
        out = np.zeros((langs, n))
        for i in range(langs):
            out[i] = np.bincount(owner[order], count[i], n)
        return out.T

    def judged(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (a position in ``languages``) and lead of each text."""
        entropy = self.phrases(data, at) * self.bits / np.maximum(np.diff(at), 1)[:, None]
        best = entropy.argmin(1)
        if len(self.languages) < 2:
            return best, np.ones(len(best))
        two = np.partition(entropy, 1, axis=1)[:, :2]
        return best, np.where(two[:, 1] > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12), 0.0)


@lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(samples))


def _predictor(samples: tuple[tuple[str, str], ...]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parser = _parser(samples)
            best, lead = parser.judged(*text_bytes(batch.column("text")))
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            names = np.array([*parser.languages, UNKNOWN], object)
            pick = np.where(letter, best, len(parser.languages))
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[pick], pa.string()), pa.array(np.where(letter, lead, 0.0))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def held_out(doc_id: F.Column, folds: int = 5) -> F.Column:
    """Rows that are never learned from; a null id is one of them."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def _letters(text: F.Column) -> F.Column:
    """Lower-cased letters; all between them is one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Lower-cased labelled text per language, from rows that aren't held out."""
    plain = documents(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    mark = F.xxhash64("doc_id")
    few = plain.select("doc_id", "lang", mark.alias("mark")).withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("mark", "doc_id")))
    few = few.where(F.col("n") <= rows).select(F.col("doc_id").alias("few_id"), F.col("lang").alias("few_lang"), "n")
    cut = plain.join(F.broadcast(few), (F.col("doc_id") == F.col("few_id")) & (F.col("lang") == F.col("few_lang")))  # rows x languages
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), room).cast("int") + 1
    cut = cut.select("lang", "n", _letters(F.substring("text", begin, F.lit(chars))).alias("text")).toPandas()
    cut = cut.sort_values(["lang", "n", "text"]).drop_duplicates(["lang", "n"])
    return {lang: "\n".join(part["text"]) for lang, part in cut.groupby("lang")}


def identified(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    kind = dict(docs.dtypes).get("doc_id", "string")
    samples = labelled_sample(docs) if samples is None else samples
    plain = documents(docs, "doc_id", "text").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), _letters(F.col("text")).alias("text"),
        (F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(samples))).alias("letter"),
    )
    if not samples:
        return plain.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return plain.mapInArrow(_predictor(tuple(sorted(samples.items()))), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
