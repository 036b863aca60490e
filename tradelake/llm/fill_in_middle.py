"""Fill-in-middle: texts cut at two units of their own and put in prefix-suffix-middle order.

A unit is a run of ASCII letters or any other single code point. The bytes of a
text are read as 64-bit words: arithmetic on a word marks the bytes that end a
unit, a bit count gives the units of each word, a search in the running counts
finds the word that holds the k-th unit, and a multiplication finds its byte
there. No text is walked unit by unit.

Cuts, form and order come from the sha256 of `seed` and id, so a row's result
depends on nothing else. A text that is empty or holds a mark stays plain. A
null text is an empty one, a null id counts as an empty id; rows that repeat an
id get the same cuts. Texts are taken whole at any length. Further columns (of
any name) stay in `row`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tradelake.llm.tokens import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and percent of those that begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
CHUNK_BYTES = 4_000_000

_HIGH, _ONES = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101)
_LOW7, _CASE = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x2020202020202020)
_FROM_A, _PAST_Z = _ONES * np.uint64(0x80 - 0x61), _ONES * np.uint64(0x80 - 0x7B)
_1, _7, _8, _56 = (np.uint64(k) for k in (1, 7, 8, 56))


class Units:
    """Units and code points of several texts; each text begins a word of its own and ends in zero bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.size = np.diff(offsets)
        words = self.size // 8 + 1  # one zero byte at least
        self.word = np.r_[0, np.cumsum(words)]  # first word of each text
        data = np.zeros(int(self.word[-1]) * 8, np.uint8)
        raw = texts.buffers()[2] if len(texts) else None
        if raw is not None:
            source = np.frombuffer(raw, np.uint8)
            for at, low, high in zip((self.word[:-1] * 8).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                data[at : at + high - low] = source[low:high]
        self.data, w = data, data.view("<u8")
        self.ends, first = self._marks(w)
        self.first = first  # marks bytes that begin a code point
        self.units_to = np.r_[0, np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)]
        self.points_to = np.r_[0, np.cumsum(np.bitwise_count(first), dtype=np.int64)]
        self.n = np.diff(self.units_to[self.word]) - (words * 8 - self.size)  # zero bytes are units too, the last ones

    @staticmethod
    def _marks(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """High bits of the bytes that end a unit, and of those that begin a code point."""
        low = (w | _CASE) & _LOW7
        letter = (low + _FROM_A) & ~(low + _PAST_Z) & ~w & _HIGH
        begins = ~(w & ~(w << _1)) & _HIGH  # all but 10xxxxxx
        following = lambda m: (m >> _8) | (np.r_[m[1:], _HIGH[None]] << _56)
        return following(begins) & ~(letter & following(letter)), begins

    def cut(self, k: np.ndarray) -> np.ndarray:
        """For each text, the bytes of its first k units."""
        rank = self.units_to[self.word[:-1]] + k
        word = np.searchsorted(self.units_to, rank, "left") - 1
        word = np.maximum(word, self.word[:-1])
        inside = (rank - self.units_to[word]).astype(np.uint64)  # 1 to 8, 0 for no unit
        counts = (self.ends[word] >> _7) * _ONES  # byte j: units that end in bytes 0 to j
        reached = ((counts | _HIGH) - inside * _ONES) & _HIGH
        place = 8 - np.bitwise_count(reached).astype(np.int64)  # bytes with fewer
        return np.where(k > 0, (word - self.word[:-1]) * 8 + place + 1, 0)

    def points(self, size: np.ndarray) -> np.ndarray:
        """For each text, the code points of its first `size` bytes."""
        word, rest = self.word[:-1] + size // 8, (size % 8).astype(np.uint64)
        below = (_1 << (rest * _8)) - _1
        return self.points_to[word] - self.points_to[self.word[:-1]] + np.bitwise_count(self.first[word] & below)


_OUT = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def _formed(cut: int, suffix_first: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    for batch in chunks(batches, "text", CHUNK_BYTES):
        units = Units(batch.column("text"))
        h = [c.to_numpy(zero_copy_only=False) for c in batch.column("h").flatten()]
        one, two = h[0] % (units.n + 1), h[1] % (units.n + 1)
        a, b = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
        before, middle = units.points(a), units.points(b)
        texts = [units.data[at : at + size].tobytes() for at, size in zip((units.word[:-1] * 8).tolist(), units.size.tolist())]
        marked = np.fromiter((any(x in t for x in marks) for t in texts), bool, len(texts))
        form = np.where((units.n == 0) | marked | (h[2] % 100 >= cut), "plain", np.where(h[3] % 100 < suffix_first, "spm", "psm"))
        out = [t if f == "plain" else p + t[:x] + s + t[y:] + m + t[x:y] if f == "psm" else s + t[y:] + p + t[:x] + m + t[x:y]
               for t, f, x, y in zip(texts, form, a.tolist(), b.tolist())]
        plain = form == "plain"
        columns = [pa.array(units.n), pa.array(form.tolist(), pa.string()), pa.array(before, mask=plain),
                   pa.array(middle - before, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *(name for name, _ in _OUT)])


def transform(docs: DataFrame, *, text: str = "text", id: str = "doc_id", seed: str = "1", cut: int = CUT,
              suffix_first: int = SUFFIX_FIRST, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(row: the kept columns of docs, n: units, form, prefix_chars, middle_chars, output) for every row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    numbers = F.struct(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)))
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"), numbers.alias("h"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(
        "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").fields])
    return rows.mapInArrow(partial(_formed, cut, suffix_first), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: a cut text holds each mark once."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2)))
            .when(form == "spm", F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))).otherwise(output))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: units, form, sizes, and digests of the output and of the text read back from it."""
    return transform(docs, keep=("doc_id",), **options).select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


REPORT_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || digest[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || digest[9:16])::BIGINT % (len(units) + 1) AS two,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
        OR ('0x' || digest[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || digest[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parted AS (
  SELECT doc_id, body, n, form, array_to_string(units[1:least(one, two)], '') AS prefix,
    array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle, array_to_string(units[greatest(one, two) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN body ELSE prefix || middle || suffix END) AS restored_sha256
FROM parted
"""
