"""Alignment of two tokenizers' tokens over the same bytes, as a sweep over their end events.

Every token ends at a byte offset of its text. The end events of both tokenizers are united, dealt out by document and
sorted by offset; a machine then passes through them. Where both tokenizers end a token a group closes. Every
distinct offset is one link: the tokens of A and B that cover the bytes before it overlap there, and
nowhere does another pair. Events travel in blocks of ids, as a token's length follows from its id; the machine holds the
events after the last closed group, and no more of a text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import keyed_join, slices, stored, table, vocabulary
from gaugeworks.llm.packing import _pieces

#: Most tokens of one event block.
BLOCK = 65_536
#: Most segments of texts whose tokens a worker keeps, and the longest such segment.
KEPT, KEPT_CHARS = 500_000, 64
#: About so many characters of texts are looked up at a time.
LEARNT_CHARS = 2_000_000
#: Both encoders are quickest on lines of about this length.
LINE_CHARS = 4_000
#: Most id pairs whose counts are broadcast to the texts; beyond it they are joined by shuffling.
BROADCAST_PAIRS = 2_000_000
#: One blank between two characters that aren't white space: both tokenizers begin a token with it, as A's pattern takes a blank to
#: what follows and no piece of B has a blank after anything but blanks. So what lies between such blanks is encoded alone.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


class Tokens:
    """Ids by both tokenizers of a blank and a text, and each token's bytes.

    a: a .tiktoken file of ranks; its ids are those of the .json file beside it. b: a .model file of BPE pieces without
    normalisation, whose encoder adds the blank itself.
    """

    def __init__(self, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k.model"):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(vocabulary(f"{a}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, file)}
        self.a = tiktoken.Encoding(a, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(b))
        spelt = {i: x for x, i in ranks.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes = (
            [spelt.get(i, b"") for i in range(max(spelt) + 1)],
            [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)],
        )
        self.lengths = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        self.separable = not any(re.search("[^▁]▁", p) for p in pieces)
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}

    def _alone(self, key: str) -> tuple[bytes, bytes] | None:
        """Ids of a blank and ``key``; None if a side's tokens don't spell it."""
        ids = self.a.encode_ordinary(" " + key), self.b.encode(key)
        raw = (" " + key).encode()
        if any(b"".join(map(self.bytes[s].__getitem__, ids[s])) != raw for s in (0, 1)):
            return None
        return tuple(np.array(x, np.uint16).tobytes() for x in ids)

    def _learn(self, keys: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """The same for many keys, joined to one text as far as they begin and end with no white space."""
        joint = [k for k in keys if not k[0].isspace() and not k[-1].isspace() and "▁" not in k]
        out: dict[str, tuple[bytes, bytes] | None] = {}
        some = []
        for low, high in slices(map(len, joint), LINE_CHARS):
            some.append(" ".join(joint[low:high]))
        if joint:
            whole = " ".join(some)
            sides = ([i for x in some for i in self.a.encode_ordinary(" " + x)], [i for x in self.b.encode(some, num_threads=1) for i in x])
            ids = tuple(np.array(x, np.uint16) for x in sides)
            stops = np.cumsum([len(k.encode()) + 1 for k in joint])
            cuts = []
            for s in (0, 1):
                ends = np.cumsum(self.lengths[s][ids[s]])
                cut = np.searchsorted(ends, stops) + 1
                cuts.append(cut if cut[-1] == len(ends) and (ends[cut - 1] == stops).all() else None)
            if all(c is not None for c in cuts) and all(b"".join(map(self.bytes[s].__getitem__, sides[s])) == (" " + whole).encode() for s in (0, 1)):
                low = [0, *cuts[0][:-1].tolist()], [0, *cuts[1][:-1].tolist()]
                raw = ids[0].tobytes(), ids[1].tobytes()
                for k, a, a2, b, b2 in zip(joint, low[0], cuts[0].tolist(), low[1], cuts[1].tolist()):
                    out[k] = raw[0][2 * a : 2 * a2], raw[1][2 * b : 2 * b2]
        for k in keys:
            if k not in out:
                out[k] = self._alone(k)
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes] | tuple[int, None, None]]:
        """(text's number, ids of A, ids of B) for every piece of every text, in order; ids little-endian unsigned 16-bit. None where
        the tokens don't spell the text. Empty texts have no pieces."""
        if not self.separable:
            for n, text in enumerate(texts):
                if text:
                    yield (n, *(self._alone(text) or (None, None)))
            return
        pieces = ((n, piece) for n, text in enumerate(texts) if text for piece in _pieces(" " + text))
        held: list[tuple[int, list[str]]] = []
        size = 0
        for n, piece in pieces:
            held.append((n, _CUT.split(piece[1:])))
            size += len(piece)
            if size > LEARNT_CHARS:
                yield from self._looked_up(held)
                held, size = [], 0
        yield from self._looked_up(held)

    def _looked_up(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple]:
        wanted = set().union(*(keys for _, keys in held))
        own: dict = {}
        new = [k for k in wanted if k not in self.kept]
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list(wanted)
        if new:
            own = self._learn(new)
            self.kept.update((k, v) for k, v in own.items() if len(k) <= KEPT_CHARS)
        known = self.kept if all(len(k) <= KEPT_CHARS for k in own) else self.kept | {k: v for k, v in own.items() if len(k) > KEPT_CHARS}
        for n, keys in held:
            got = list(map(known.__getitem__, keys))
            if None in got:
                yield n, None, None
            else:
                yield n, b"".join([x[0] for x in got]), b"".join([x[1] for x in got])


_LOADED: dict[tuple[str, str], Tokens] = {}


def shared_tokens(a: str, b: str) -> Tokens:
    """One for each worker process, however many tasks it runs."""
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Tokens(a, b)
    return _LOADED[a, b]


EVENTS = "h long, at long, side int, ids binary"


def end_events(docs: DataFrame, a: str, b: str, id: str, text: str) -> DataFrame:
    """id_, h (the text's hash), at, side (0: A, 1: B) and ids, for blocks of tokens that begin at byte ``at``; the end events are
    the running sums of the ids' lengths. A text without tokens is one row, at -1."""
    source = docs.select(docs[id].alias("id_"), F.xxhash64(docs[text].cast("string")).alias("h"), docs[text].cast("string").alias("t_"))
    kind = source.schema["id_"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = shared_tokens(a, b)
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                rows, at, side, ids = [], [], [], []
                texts = some.column(2).to_pylist()
                held: list[tuple[int, int, int, bytes]] = []  # one text's, as any piece may show that it has no tokens
                last, reached, broken = -1, 0, False

                def close(n: int) -> None:
                    for row in [(n, -1, 0, b"")] if broken or not held else held:  # noqa: B023
                        for column, value in zip((rows, at, side, ids), row):  # noqa: B023
                            column.append(value)

                done = 0
                for n, *sides in tokens.encode(texts):
                    if n != last:
                        if last >= 0:
                            close(last)
                        for empty in range(done, n):
                            held, broken = [], False
                            close(empty)
                        held, reached, broken, last, done = [], 0, False, n, n + 1
                    if sides[0] is None:
                        broken = True
                        continue
                    for s in (0, 1):
                        start = reached
                        for x in range(0, len(sides[s]), 2 * BLOCK):
                            block = sides[s][x : x + 2 * BLOCK]
                            held.append((n, start, s, block))
                            start += int(tokens.lengths[s][np.frombuffer(block, "<u2")].sum())
                    reached = start
                if last >= 0:
                    close(last)
                for empty in range(done, len(texts)):
                    held, broken = [], False
                    close(empty)
                taken = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0).take(taken), some.column(1).take(taken), pa.array(at, pa.int64()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())], ["id_", "h", "at", "side", "ids"])

    return source.mapInArrow(run, f"id_ {kind}, {EVENTS}")


class Sweep:
    """Passes through one text's end events. ``settle`` gives what lies up to the last group that is closed."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths, self.at = lengths, [0, 0]
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def feed(self, side: int, ids: bytes) -> None:
        new = np.frombuffer(ids, "<u2").astype(np.int64)
        ends = self.at[side] + np.cumsum(self.lengths[side][new])
        self.at[side] = int(ends[-1])
        self.ids[side], self.ends[side] = np.concatenate([self.ids[side], new]), np.concatenate([self.ends[side], ends])

    def settle(self):
        """(ids of A, of B, their ends, ends of groups), or None if no group has closed since."""
        a, b = self.ends
        closed = np.intersect1d(a, b, assume_unique=True) if len(a) and len(b) else a[:0]
        if not len(closed):
            return None
        n = [int(np.searchsorted(e, closed[-1], "right")) for e in (a, b)]
        out = self.ids[0][: n[0]], self.ids[1][: n[1]], a[: n[0]], b[: n[1]], closed
        for s in (0, 1):
            self.ids[s], self.ends[s] = self.ids[s][n[s] :], self.ends[s][n[s] :]
        return out


def linked(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, A's token number, B's) of every link: each distinct end event is where one pair's overlap ends."""
    ends = np.concatenate([a_ends, b_ends])
    order = np.argsort(ends, kind="stable")  # two sorted runs are merged; of equal offsets A's comes first
    ends, of_b = ends[order], order >= len(a_ends)
    at = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
    b_before = np.cumsum(of_b)[at] - of_b[at]
    return ends[at], at - b_before, b_before


#: Decimal ids, each with one of the separators that may follow it, as rows of bytes; what isn't used is 0.
_SPELT = np.frombuffer(b"".join(f"{i}{c}".encode().ljust(6, b"\0") for i in range(1 << 16) for c in ",|;"), np.uint8).reshape(-1, 6)


def spelt_groups(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, closed: np.ndarray) -> bytes:
    """a1,a2|b1;a3|b2,b3; for groups in order, each with its semicolon."""
    key = np.concatenate([2 * np.searchsorted(closed, a_ends), 2 * np.searchsorted(closed, b_ends) + 1])
    order = np.argsort(key, kind="stable")
    key = key[order]
    last = np.append(key[1:] != key[:-1], True)
    rows = _SPELT[3 * np.concatenate([a, b])[order] + np.where(last, 1 + (key & 1), 0)]
    return rows[rows != 0].tobytes()


class _Summary:
    """What the query asks of a text: counts, the digest of its groups, and its id pairs with the number of links of each."""

    def __init__(self, tokens: Tokens):
        self.wide = len(tokens.bytes[1])
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.sha, self.rest = hashlib.sha256(), b""
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, a, b, a_ends, b_ends, closed) -> None:
        ends, i, j = linked(a_ends, b_ends)
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + len(a), self.n_b + len(b), self.n_groups + len(closed), self.n_links + len(ends)
        text = self.rest + spelt_groups(a, b, a_ends, b_ends, closed)
        self.sha.update(text[:-1])
        self.rest = b";"  # owed before the next group
        pairs, times = np.unique(a[i] * self.wide + b[j], return_counts=True)
        if len(self.pairs):
            pairs, back = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            times = np.bincount(back, np.concatenate([self.times, times]), len(pairs)).astype(np.int64)
        self.pairs, self.times = pairs, times

    SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
    TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def rows(self) -> Iterator[tuple]:
        yield self.n_a, self.n_b, self.n_groups, self.n_links, self.sha.hexdigest() if self.n_a else "", self.pairs.astype(np.int32), self.times.astype(np.int32)


class _Groups:
    """Groups and links themselves, in rows of those that closed together."""

    def __init__(self, tokens: Tokens):
        self.out, self.n, self.start = [], [0, 0, 0], 0

    def take(self, a, b, a_ends, b_ends, closed) -> None:
        ends, i, j = linked(a_ends, b_ends)
        starts = np.concatenate([[self.start], closed[:-1]])
        cut = lambda ids, at: np.split(ids, np.searchsorted(at, closed[:-1], "right"))
        groups = [{"start": s, "end": e, "a": x.tolist(), "b": y.tolist()} for s, e, x, y in zip(starts.tolist(), closed.tolist(), cut(a, a_ends), cut(b, b_ends))]
        begins = np.concatenate([[self.start], ends[:-1]])
        links = [{"a": x, "b": y, "a_id": u, "b_id": v, "start": s, "end": e} for x, y, u, v, s, e in zip((i + self.n[1]).tolist(), (j + self.n[2]).tolist(), a[i].tolist(), b[j].tolist(), begins.tolist(), ends.tolist())]
        self.out.append((self.n[0], groups, links))
        self.n, self.start = [self.n[0] + len(closed), self.n[1] + len(a), self.n[2] + len(b)], int(closed[-1])

    SCHEMA = "first_group long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>, links array<struct<a:long,b:long,a_id:int,b_id:int,start:long,end:long>>"
    TYPES = (
        pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])),
        pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("a_id", pa.int32()), ("b_id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])),
    )

    def rows(self) -> Iterator[tuple]:
        out, self.out = self.out, []
        yield from out


def _swept(events: DataFrame, a: str, b: str, told: type) -> DataFrame:
    """id_, h, copies and what ``told`` makes of each text: events dealt by document, in order of offset, through the machine."""
    kind = events.schema["id_"].dataType.simpleString()
    names = ["id_", "h", "copies", *(x.split()[0] for x in re.split(r", (?=\w+ )", told.SCHEMA))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = sweep = made = block = None
        copies, out = 0, []

        def batch_of(schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [schema.field("id_").type, pa.int64(), pa.int64(), *told.TYPES]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            out.clear()
            return got

        schema = None
        for batch in batches:
            tokens, schema = shared_tokens(a, b), batch.schema
            columns = (batch.column(i).to_pylist() for i in range(4))
            for row, (d, h, at, side) in enumerate(zip(*columns)):
                if key != (d, h):
                    if key is not None:
                        out += [(*key, copies, *x) for x in made.rows()]
                    key, first, block, copies = (d, h), (at, side), None, 0
                    sweep, made = Sweep(tokens.lengths), told(tokens)
                copies += (at, side) == first  # repeated rows have the same blocks, which stand side by side
                if at >= 0 and block != (at, side):
                    block = (at, side)
                    sweep.feed(side, batch.column(4)[row].as_py())
                    got = sweep.settle()
                    if got:
                        made.take(*got)
                if len(out) >= 200:
                    yield batch_of(schema)
        if key is not None:
            out += [(*key, copies, *x) for x in made.rows()]
        if out:
            yield batch_of(schema)

    dealt = events.repartition("id_", "h").sortWithinPartitions("id_", "h", "at", "side")
    return dealt.mapInArrow(run, f"id_ {kind}, h long, copies long, {told.SCHEMA}")


def alignment(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k.model", id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, copies, first_group, groups and links: a text's groups in order, in rows of those that closed together.

    groups: byte range (of a blank and the text) and ids of both sides; links: the tokens' numbers, their ids and the bytes they share. copies: how many
    rows have this id and text. Null, empty and other texts without tokens (see ``aligned_counts``) have no rows.
    """
    out = _swept(end_events(docs, a, b, id, text), a, b, _Groups)
    return out.select(F.col("id_").alias(id), "copies", "first_group", "groups", "links")


def aligned_counts(docs: DataFrame, a: str = "byte_bpe_50k", b: str = "piece_bpe_32k.model", id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text has no tokens, and zeros, if it is null or empty or if a side's tokens don't spell the blank and the text byte by byte (a text
    with U+2581, which B reads as a blank). An id pair counts the rows of ``docs`` that hold it linked; n_best counts links whose pair
    counts as much as any of its A id, ties included. Repeated rows, also of one id, and null ids are answered each; of an empty table nothing. Other columns
    are not looked at. Whole texts are read.
    """
    swept = stored(_swept(end_events(docs, a, b, id, text), a, b, _Summary), "alignment")
    wide = F.lit(_wide(b)).cast("int")
    pairs = swept.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("docs"))
    pairs = stored(pairs.withColumn("a_", F.call_function("div", F.col("pair"), wide)), "alignment-pairs")
    most = pairs.groupBy("a_").agg(F.max("docs").alias("most"))
    counts = stored(pairs.join(most, "a_").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "alignment-counts")
    each = swept.select("id_", "h", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    if counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        met = each.join(F.broadcast(counts), "pair")
    else:
        met = keyed_join(each, counts, ["pair"], by=["id_", "h"])
    sums = met.groupBy("id_", "h").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    sums = sums.select(F.col("id_").alias("i_"), F.col("h").alias("h_"), "n_best", "count_sum")
    out = swept.drop("pairs", "times").join(sums, F.expr("id_ <=> i_ and h <=> h_"), "left").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id_").alias(id), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def _wide(b: str) -> int:
    """Ids of B: what a pair's A id is multiplied by. All pairs of the two vocabularies lie below 2**31."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(b)).get_piece_size()


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_counts(table(spark, sf_dir, "documents"))
