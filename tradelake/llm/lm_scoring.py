"""Language-model scores of whole documents.

All training texts are counted: every token's count, and the mass and size of
its class. A gated recurrent model (gru.py) over classes and frequent tokens
learns from all of them, whole: it starts with some passes over `sample_docs`
documents, chosen by hash, in one task; then in each of `ROUNDS` rounds every
task goes on from the same weights over its own share of that round's texts, and
the weights that come out are averaged by tokens. Every training document is in
one round. Another partitioning gives slightly other weights. A document's score is the model's log10 probability: class
and frequent token from the recurrent state, a rarer token within its class by
its count, with one added.

Counts of the `listed` most frequent tokens go to all tasks; that table has a
fixed size. The other tokens of a document meet their counts in a join; none of
them is frequent, so no key is hot.

Held out are documents whose crc32 of the id as text leaves 2 on division by 7.
A null text is empty: one end token. A null id is never held out. Rows that
repeat an id or text are scored each. Further columns are ignored. Without any
training text, every token is unknown and the model knows nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tradelake.llm.gru import GROUPS, HEAD, TAIL, Gru
from tradelake.llm.staging import staged
from tradelake.llm.tokens import Words, chunks, mix, words

SAMPLE_DOCS, LISTED, LANES, EPOCHS = 1500, 1 << 16, 96, 3
COUNT_BYTES, SCORE_BYTES = 2_000_000, 6_000_000
#: Rounds over all training texts; a task learns from blocks of about so many tokens.
ROUNDS, BLOCK, ROUND_LANES, RATE = 4, 1 << 20, 256, 0.005
#: Fewest occurrences of a token that the model knows by itself; so it also learns what rare tokens look like.
FREQUENT = 3
#: Stands for the end of a text.
END = np.int64(0x0E0D0C0B0A090807)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def tail_class(w: Words) -> np.ndarray:
    """A class by the first two and last two bytes of a word, which say much about language and form."""
    if not len(w.hash):
        return np.zeros(0, np.int64)
    second = np.minimum(w.start + 1, w.end - 1)
    key = sum(w.data[at].astype(np.uint64) << np.uint64(8 * k) for k, at in
              enumerate((w.start, second, np.maximum(w.end - 2, w.start), w.end - 1)))
    return (mix(key) % np.uint64(TAIL)).astype(np.int64)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", COUNT_BYTES):
        w = words(batch.column("text"))
        token, first, count = np.unique(w.hash, return_index=True, return_counts=True)
        cls = tail_class(w)[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[token.view(np.int64), END]), pa.array(np.r_[cls, -1].astype(np.int16)),
             pa.array(np.r_[count, batch.num_rows])], ["token", "class", "n"])


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, class, n) over all texts, written to the shared folder."""
    parts = docs.select("text").mapInArrow(_counting, "token bigint, class smallint, n bigint")
    return staged(parts.groupBy("token", "class").agg(F.sum("n").alias("n")), "tokens")


class Lexicon:
    """What every task knows of the counts: the listed tokens, and each class's mass."""

    def __init__(self, counts: DataFrame, listed: int):
        n = F.sum("n").alias("n")
        self.total, self.size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        end = counts.where(F.col("token") == int(END))  # the end of a text is number 0
        common = counts.where(F.col("token") != int(END)).orderBy(F.col("n").desc(), "token").limit(listed)
        top = pd.concat([end.toPandas(), common.toPandas()], ignore_index=True)
        if not len(end.take(1)):
            top = pd.concat([pd.DataFrame({"token": [END], "class": [-1], "n": [0]}), top], ignore_index=True)
        place = np.arange(len(top))
        frequent = (place < HEAD) & ((top["n"].to_numpy() >= FREQUENT) | (place == 0))
        self.counts_head = np.zeros(HEAD + TAIL)
        self.counts_head[: frequent.sum()] = top["n"][frequent]
        number = np.where(frequent, place, HEAD + np.maximum(top["class"], 0))
        by = np.argsort(top["token"].to_numpy())
        self.token, self.n, self.number = top["token"].to_numpy()[by], top["n"].to_numpy()[by], number[by].astype(np.int64)
        rest = counts.where(~F.col("token").isin(top["token"][frequent].tolist()))
        self.mass = np.ones(TAIL)  # of a class: its tokens, and one for each kind and for the unseen
        for cls, total, kinds in rest.groupBy("class").agg(n, F.count("*")).collect():
            self.mass[max(cls, 0)] += total + kinds
            self.counts_head[HEAD + max(cls, 0)] += total

    def numbers(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """A number for the model for each word, and its count, 0 where it is not listed."""
        token = w.hash.view(np.int64)
        at = np.searchsorted(self.token, token)
        here = at < len(self.token)
        here[here] = self.token[at[here]] == token[here]
        number = HEAD + tail_class(w)
        number[here] = self.number[at[here]]
        n = np.zeros(len(token), np.int64)
        n[here] = self.n[at[here]]
        return number, n


def _texts(w: Words, number: np.ndarray) -> list[np.ndarray]:
    return [np.append(number[a:b], 0) for a, b in zip(w.first, w.first[1:])]


def _learning(lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample: the model's weights."""
    model, stream, order = Gru.start(lexicon.value.counts_head), [], []
    for batch in chunks(batches, "text", SCORE_BYTES):
        w = words(batch.column("text"))
        stream += _texts(w, lexicon.value.numbers(w)[0])
        order += batch.column("order").to_pylist()
    if stream:
        model.learn(np.concatenate([stream[k] for k in sorted(range(len(stream)), key=order.__getitem__)]), LANES, EPOCHS)
    yield pa.RecordBatch.from_arrays([pa.array(list(model.p)), pa.array([v.tobytes() for v in model.p.values()])], ["name", "weights"])


def _going_on(lexicon, model, rate: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's share of a round: its weights times the tokens it has read, and those."""
    own, stream, size, total = Gru({k: v.copy() for k, v in model.value.p.items()}), [], 0, 0

    def learn() -> None:
        own.learn(np.concatenate(stream), ROUND_LANES, 1, rate)

    for batch in chunks(batches, "text", COUNT_BYTES):
        w = words(batch.column("text"))
        for text in _texts(w, lexicon.value.numbers(w)[0]):
            stream.append(text)
            size, total = size + len(text), total + len(text)
            if size >= BLOCK:
                learn()
                stream, size = [], 0
    if size:
        learn()
    if total:
        values = [(v.astype(np.float64) * total).tobytes() for v in own.p.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(own.p)), pa.array([total] * len(values)), pa.array(values)], ["name", "n", "weights"])


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("task")
    total = sum(np.frombuffer(v.as_py(), np.float64) for v in table["weights"])
    return pa.table({"name": pa.array([key[0].as_py()]), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()),
                     "task": pa.array([min(table["task"].to_pylist())], pa.int32()), "weights": pa.array([total.tobytes()])})


def train(docs: DataFrame, lexicon, sample_docs: int) -> Gru:
    order = F.xxhash64("doc_id", F.crc32("text"))
    chosen = docs.select("text", order.alias("order")).orderBy("order", "text").limit(sample_docs)
    got = chosen.coalesce(1).mapInArrow(partial(_learning, lexicon), "name string, weights binary").collect()
    model = Gru.start(lexicon.value.counts_head)
    for r in got:
        model.p[r.name] = np.frombuffer(r.weights, np.float32).reshape(model.p[r.name].shape).copy()
    kept = "name string, n bigint, task int, weights binary"
    for k in range(ROUNDS):
        now = docs.sparkSession.sparkContext.broadcast(model)
        texts = docs.where(F.pmod(order, F.lit(ROUNDS)) == k).select("text")
        parts = texts.mapInArrow(partial(_going_on, lexicon, now, RATE * (1 - k / ROUNDS)), "name string, n bigint, weights binary")
        parts = parts.select("name", "n", F.spark_partition_id().alias("task"), "weights")
        parts = parts.groupBy("name", F.pmod("task", F.lit(16)).alias("part")).applyInArrow(_summed, kept)  # fixed sizes, in two steps
        for r in parts.groupBy("name").applyInArrow(_summed, kept).collect():
            model.p[r.name] = (np.frombuffer(r.weights, np.float64) / r.n).reshape(model.p[r.name].shape).astype(np.float32)
        now.unpersist()
    return model


def _scoring(lexicon, model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = lexicon.value
    log_mass = np.log10(known.mass)
    ends = int(known.n[known.token == END].sum())
    for batch in chunks(batches, "text", SCORE_BYTES):
        w = words(batch.column("text"))
        number, n = known.numbers(w)
        text, rows = w.text_of_word(), batch.num_rows
        score = model.value.score(_texts(w, number)) / np.log(10)
        rare = number >= HEAD
        score -= np.bincount(text[rare], log_mass[number[rare] - HEAD], rows)
        plus = np.log10(n + 1.0)
        score += np.bincount(text[rare], plus[rare], rows)
        base = np.bincount(text, plus, rows) + np.log10(ends + 1.0)
        seen = np.bincount(text[n > 0], minlength=rows) + (ends > 0)
        left = np.flatnonzero(n == 0)
        offsets = np.searchsorted(text[left], np.arange(rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.hash.view(np.int64)[left]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(w.first) + 1), pa.array(seen), pa.array(base), pa.array(score), lists],
            ["doc_id", "n_tokens", "n_known", "base", "score", "rest"])


def report(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, listed: int = LISTED) -> DataFrame:
    """One row per document: tokens, the smoothed unigram score and the model's score."""
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    training = docs.where(~held_out(F.col("doc_id")))
    counts = count_tokens(training)
    found = Lexicon(counts, listed)
    lexicon = context.broadcast(found)  # at most `listed` rows
    model = context.broadcast(train(training, lexicon, sample_docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double, rest array<bigint>"
    scored = docs.mapInArrow(partial(_scoring, lexicon, model), schema)
    scored = staged(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
    met = scored.select("row", F.explode("rest").alias("token")).join(counts.select("token", "n"), "token")
    more = met.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("known"))
    out = scored.drop("rest").join(more, "row", "left").na.fill({"more": 0.0, "known": 0})
    below = float(np.log10(found.total + found.size + 1))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(int(found.total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * below).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"))
