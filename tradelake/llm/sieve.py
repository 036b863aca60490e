"""A fixed-size sieve of ids, to thin a large table before a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 1 << 23
_PAGE = 1 << 15  # bits in a value of bitmap_construct_agg


def sifted(df: DataFrame, ids: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Rows of df whose id may be in ids (one column); every row whose id is there stays.

    The sieve is a bitmap over hashes of the ids: 1 MB however many there are.
    With far more ids than bits it lets everything through, which costs time
    and changes nothing.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    s = ids.select((slot(F.col(ids.columns[0])) + 1).alias("slot"))  # the bitmap functions number pages from 1 for 1 and up
    pages = s.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map"))
    table = np.zeros(-(-bits // _PAGE) * _PAGE // 8, np.uint8)
    for page, found in pages.collect():  # at most bits / 32768 rows of 4 KB
        table[(page - 1) * _PAGE // 8 : page * _PAGE // 8] = np.frombuffer(found, np.uint8)
    packed = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_slot").to_numpy()
            here = packed.value[at >> 3] >> (at & 7).astype(np.uint8) & 1
            yield batch.filter(pa.array(here.astype(bool))).drop_columns(["_slot"])

    return df.withColumn("_slot", slot(F.col(column))).mapInArrow(run, df.schema)
