"""Best-fit packing of token sequences in bulk-synchronous rounds.

Each round range-sorts the unplaced pieces and the gaps of the open sequences
together. A sweep over each sorted range gives every gap, from the smallest on,
the largest piece before it that is still free, so each piece goes to its
successor among the gaps and conflicts are settled by rank. What a range leaves
over meets across ranges the same way: only the counts of each range come to
the driver, and rows find each other by their rank. Gaps shrink and the next
round begins. When nothing fits any more, the largest pieces open as many
sequences as the rest fills at least.

Tokenising is per word: white space always ends a token of this vocabulary, so
the ids of a word are looked up, and only new words are encoded.

A null or empty text is the end id alone. Rows that repeat an id are documents
of their own. Longer documents are cut into full pieces and a rest. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradelake.llm.staging import discard, staged
from tradelake.llm.tokens import chunks, words

CAPACITY, END_ID = 4096, 1
#: The first opening is for this part of all tokens, so that later ones can mend; the round from which gaps take several pieces.
OPENING, SEVERAL = 0.99, 6
VOCABULARY = "word_bpe_49k.json"
CHUNK_BYTES, CACHED_WORDS = 2_000_000, 1_500_000


class WordIds:
    """Token ids of words, by the fingerprint of the word."""

    def __init__(self, path: str | None, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.forget()

    def forget(self) -> None:
        self.hash, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text begins."""
        w = words(texts)
        different, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.hash) > CACHED_WORDS:
            self.forget()
        known = np.searchsorted(self.hash, different)
        there = known < len(self.hash)
        there[there] = self.hash[known[there]] == different[there]
        new = np.flatnonzero(~there)
        if len(new):
            data = w.data.tobytes()
            texts_ = [data[w.start[k] : w.end[k]].decode() for k in first[new]]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            place = known[new]  # both are sorted: merged, not sorted again
            self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(size) - size)
            self.size = np.insert(self.size, place, size)
            self.ids = np.r_[self.ids, np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))]
            self.hash = np.insert(self.hash, place, different[new])
            known = np.searchsorted(self.hash, different)
        known = known[back]
        size = self.size[known]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - self.at[known], size)
        return self.ids[place], np.r_[0, ends][w.first]


def _cutting(path: str | None, special_as_text: bool, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = WordIds(path, special_as_text)
    for batch in chunks(batches, "text", CHUNK_BYTES):
        ids, first = coder.ids_of(batch.column("text"))
        row, piece, start, length, crc = [], [], [], [], []
        for k in range(batch.num_rows):
            own = np.append(ids[first[k] : first[k + 1]], np.uint32(END_ID)).astype("<u4")
            for n, a in enumerate(range(0, len(own), capacity)):
                part = own[a : a + capacity]
                for values, v in ((row, k), (piece, n), (start, a), (length, len(part)), (crc, zlib.crc32(part.tobytes()))):
                    values.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
             *(pa.array(v, pa.int64()) for v in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, *, tokenizer: str | None = None, special_as_text: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """(pid, doc_id, piece, start, length, ids_crc32) of all documents, written to the shared folder.

    Strings of special tokens in a text become these tokens, as the tokenizer
    has it; with `special_as_text` they are ordinary text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(
        partial(_cutting, tokenizer, special_as_text, capacity), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return staged(cut.select(F.monotonically_increasing_id().alias("pid"), "*"), "pieces")


#: Rows of a sweep. A piece has the gap it goes to and that gap's room then; a gap has the last piece it took and the
#: room left. What is left over has a rank, from the best on. One row without `gap` counts for its range: pieces left,
#: gaps left, pieces placed, tokens left.
SWEPT = "part int, gap boolean, id bigint, value bigint, mate bigint, room bigint, rank bigint"


def _sweep(several: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: pieces wait on a stack, a gap takes the topmost."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    gap, ids, value = (t[c].to_pylist() for c in ("gap", "id", "value"))
    n = len(ids)
    mate, room, rank, stack, free = [None] * n, [None] * n, [None] * n, [], 0
    for k, is_gap in enumerate(gap):
        if not is_gap:
            stack.append(k)
        elif stack:
            left = value[k]
            while stack and value[stack[-1]] <= left and (several or mate[k] is None):
                top = stack.pop()
                mate[k], mate[top], room[top] = ids[top], ids[k], left
                left -= value[top]
            room[k] = left
        else:
            rank[k], free = free, free + 1
    for r, k in enumerate(reversed(stack)):
        rank[k] = r
    tokens, met = sum(value[k] for k in stack), gap.count(False) - len(stack)
    part = t["part"][0].as_py()
    ints = [ids + [len(stack)], value + [free], mate + [met], room + [tokens], rank + [None]]
    yield pa.RecordBatch.from_arrays(
        [pa.array([part] * (n + 1), pa.int32()), pa.array(gap + [None], pa.bool_()), *(pa.array(x, pa.int64()) for x in ints)],
        ["part", "gap", "id", "value", "mate", "room", "rank"])


def _flows(left: list) -> list[tuple[int, int, int, int, int, int]]:
    """Across ranges: (piece's part, its first rank, gap's part, its first rank, how many, first number)."""
    stack, out, number = [], [], 0
    for r in left:
        gaps, taken = r.gaps, 0
        while gaps and stack:
            part, rank, count = stack.pop()
            n = min(gaps, count)
            out.append((part, rank, r.part, taken, n, number))
            number, taken, gaps = number + n, taken + n, gaps - n
            if count > n:
                stack.append((part, rank + n, count - n))
        if r.pieces:
            stack.append((r.part, 0, r.pieces))
    return out


def _numbering(part: np.ndarray, rank: np.ndarray, n: np.ndarray, number: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p, r = batch.column("part").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
        own = np.searchsorted(part << 40 | rank, p << 40 | r, "right") - 1
        at = np.maximum(own, 0)
        hit = (own >= 0) & (part[at] == p) & (r < rank[at] + n[at]) if len(part) else np.zeros(len(p), bool)
        value = number[at] + r - rank[at] if len(part) else np.zeros(len(p), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("value"), pa.array(value, mask=~hit)], ["id", "value", "number"])


def _numbered(left: DataFrame, flows: list[tuple], side: int) -> DataFrame:
    """What a round leaves over, with the number of its match across ranges, null if it has none.

    Flows are no more than twice the ranges. Each row finds its own by binary
    search as it is read; `side` is 0 for pieces and 2 for gaps.
    """
    f = np.array(sorted((f[side], f[side + 1], f[4], f[5]) for f in flows), np.int64).reshape(-1, 4)
    return left.select("part", "rank", "id", "value").mapInArrow(partial(_numbering, *f.T), "id bigint, value bigint, number bigint")


def _round(docs: DataFrame, bins: DataFrame, capacity: int, turn: int, made: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """What this round places (pid, seq, gap), the rest, the new gaps, and how many pieces are left.

    One shuffle sorts, another brings matches across ranges together; the rest
    is read from the sweep's rows as they lie.
    """
    both = docs.select(F.lit(False).alias("gap"), F.col("pid").alias("id"), F.col("length").alias("value")).unionAll(
        bins.select(F.lit(True), "seq", "room"))
    order = ("value", "gap", F.xxhash64("id"), "id")
    swept = both.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "*")
    swept = staged(swept.mapInArrow(partial(_sweep, turn >= SEVERAL), SWEPT), "pack-sweep", made)
    left = swept.where("gap IS NULL").select("part", F.col("id").alias("pieces"), F.col("value").alias("gaps"), F.col("mate").alias("met"),
                                             F.col("room").alias("tokens")).collect()  # one row for each range
    left.sort(key=lambda r: r.part)
    flows, opening = _flows(left), False
    if not flows and not any(r.met for r in left):  # nothing fits: the largest open new sequences
        opening = True
        tokens = sum(r.tokens for r in left) * (OPENING if turn == 1 else 1)
        need, before = max(1, math.ceil(tokens / capacity)), 0
        for r in reversed(left):
            flows.append((r.part, 0, r.part, 0, max(0, min(r.pieces, need - before)), 0))
            before += r.pieces
    pieces_left = _numbered(swept.where("NOT gap AND rank IS NOT NULL"), flows, 0)
    gaps_left = swept.where("gap AND rank IS NOT NULL")
    crossing = pieces_left.where("number IS NOT NULL").select(F.col("id").alias("pid"), F.col("value").alias("length"), "number")
    if opening:
        crossing = crossing.select("pid", F.col("pid").alias("seq"), F.lit(capacity).cast("bigint").alias("gap"), "length")
        gaps_left = gaps_left.select("id", "value")
    else:
        gaps_left = _numbered(gaps_left, flows, 2)
        taken = gaps_left.where("number IS NOT NULL").select("number", F.col("id").alias("seq"), F.col("value").alias("gap"))
        crossing = staged(crossing.join(taken, "number").select("pid", "seq", "gap", "length"), "pack-crossing", made) if flows else crossing.select(
            "pid", F.col("pid").alias("seq"), F.col("length").alias("gap"), "length")
        gaps_left = gaps_left.where("number IS NULL").select("id", "value")
    placed = swept.where("NOT gap AND mate IS NOT NULL").select(F.col("id").alias("pid"), F.col("mate").alias("seq"), F.col("room").alias("gap"))
    placed = placed.unionAll(crossing.drop("length"))
    bins = swept.where("gap AND mate IS NOT NULL").select(F.col("id").alias("seq"), "room").unionAll(gaps_left).unionAll(
        crossing.select("seq", F.col("gap") - F.col("length"))).where("room > 0")
    docs = pieces_left.where("number IS NULL").select(F.col("id").alias("pid"), F.col("value").alias("length"))
    return placed, docs, bins, sum(r.pieces for r in left) - sum(f[4] for f in flows)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(pid, sequence_id, offset) of every row of cut (pid, length).

    Of each round only the places it gave are kept; its other tables go once the
    next round has read them.
    """
    spark, last = cut.sparkSession, []
    full = cut.where(F.col("length") >= capacity).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    docs = cut.where(F.col("length") < capacity).select("pid", "length")
    bins = docs.limit(0).select(F.col("pid").alias("seq"), F.col("length").alias("room"))
    out, count, turn = full, docs.count(), 1
    while count:
        made: list[str] = []
        placed, docs, bins, count = _round(docs, bins, capacity, turn, made)
        turn += 1
        out = out.unionAll(staged(placed.select("pid", "seq", (capacity - F.col("gap")).alias("offset")), "pack-placed"))
        discard(spark, last)
        last = made
    discard(spark, last)
    return out


def report(docs: DataFrame, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece: where it comes from and where it is packed."""
    cut = pieces(docs, capacity=capacity, **options)
    return cut.join(pack(cut, capacity), "pid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
