"""A bitmap of fixed size that tells which rows may be in a set of keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def only_marked(rows: DataFrame, key: str, wanted: DataFrame, marked: bool = True) -> DataFrame:
    """Rows whose key may be in the column ``key`` of ``wanted``; all rows of wanted keys pass.

    With ``marked`` false the other rows, whose keys are surely not in it.

    The bitmap has BITS bits (4 MB) whatever the data. Hashes that fall on one bit let other rows
    pass, all of them when there are very many keys; a join that follows removes them. It only
    saves shuffling texts that cannot meet a partner. Python sees the numbers of the bits only, no texts.
    """
    spot = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))
    found = (
        wanted.select((spot + 1).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    )
    bits = np.zeros(BITS // 8, np.uint8)
    for r in found:  # bucket b, from 1, holds 32,768 spots, the lowest bit of a byte first
        bits[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    marks = rows.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def passes(spots: pa.Array) -> pa.Array:
        at = spots.to_numpy(zero_copy_only=False)
        return pa.array(((marks.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1) == marked)

    return rows.filter(passes(spot))
