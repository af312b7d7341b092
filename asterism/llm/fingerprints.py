"""Document fingerprints by winnowing. DataFrame functions only.

Every run of ``k`` bytes of the UTF-8 text is hashed to 33 bits. In every window of ``SPAN`` * ``SPAN``
consecutive hashes the smallest is selected, the rightmost of equal ones. Two texts that share
``guarantee(k)`` bytes in a row share a selected hash. A pick is one number, ``hash * 2^31 - (place + 1)``,
so that the minimum of plain numbers is the minimum hash with the rightmost tie rule, and a
pick moves by ``n`` bytes when ``n`` is subtracted from it.

Defined cases: a null text is empty; an empty text has no picks and is like an empty text only;
a text below ``guarantee(k)`` bytes is one window; rows with a null or repeated id are documents of
their own, see ``with_next``; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

K = 12
SPAN = 5
WINDOW = SPAN * SPAN
ROWS_PER_CELL = 64
MOST_CELLS = 1 << 14
SEEN_PER_CELL = 32  # ids from which the cells' bounds are taken; they lay out the rows and decide nothing else

_UNIT = 1 << 31


def guarantee(k: int = K) -> int:
    """Bytes of one full window: any shared run of this length is noticed."""
    return k + WINDOW - 1


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once, also when f uses it inside another lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _keys(raw: Column, k: int) -> Column:
    grams = F.sequence(F.lit(1), F.greatest(F.length(raw) - (k - 1), F.lit(1)))
    return F.transform(grams, lambda i: F.xxhash64(raw.substr(i, F.lit(k))).bitwiseAND(F.lit(-_UNIT)) - i)


def _minima(values: Column, step: int) -> Column:
    """At i the smallest of values[i], values[i + step], ...; SPAN of them."""
    return F.transform(
        values, lambda x, i: F.least(x, *(F.get(values, i + j * step) for j in range(1, SPAN)))
    )


def picks(raw: Column, k: int = K) -> Column:
    """Selected k-grams of a binary value, in order of place."""
    each = bind(bind(bind(raw, lambda b: _keys(b, k)), lambda v: _minima(v, 1)), lambda v: _minima(v, SPAN))
    full = bind(each, lambda m: F.slice(m, 1, F.greatest(F.size(m) - (WINDOW - 1), F.lit(1))))
    return F.when(F.length(raw) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(full))


def pick_hash(pick: Column) -> Column:
    return F.shiftright(pick, 31) + 1


def pick_place(pick: Column) -> Column:
    """Byte at which the k-gram starts."""
    return pick_hash(pick) * _UNIT - pick - 1


def picks_before(selected: Column, bound: Column) -> Column:
    """Picks of the windows that start before byte ``bound``.

    A pick is first selected when it enters the window, if it is smaller than the pick before it,
    and else when the pick before it has left the window.
    """

    def first(pick, j):
        before = F.get(selected, j - 1)
        return (
            F.when(j == 0, F.lit(0))
            .when(pick < before, pick_place(pick) - (WINDOW - 1))
            .otherwise(pick_place(before) + 1)
        )

    return F.filter(selected, lambda pick, j: first(pick, j) < bound)


def fingerprint(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """All columns of ``docs`` and ``picks``, in the place of one of that name; row by row, nothing is shuffled."""
    return docs.withColumn("picks", picks(F.encode(text_or_empty(F.col(text)), "utf-8"), k))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the hashes of two arrays of picks; 1 for two empty ones."""
    x, y = (F.array_distinct(F.transform(p, pick_hash)) for p in (a, b))
    both = F.array(x, y)
    return bind(
        both,
        lambda p: bind(
            F.size(F.array_intersect(F.get(p, F.lit(0)), F.get(p, F.lit(1)))).cast("double"),
            lambda shared: F.when(
                F.size(F.get(p, F.lit(0))) + F.size(F.get(p, F.lit(1))) == 0, F.lit(1.0)
            ).otherwise(shared / (F.size(F.get(p, F.lit(0))) + F.size(F.get(p, F.lit(1))) - shared)),
        ),
    )


def spelled(selected: Column) -> Column:
    """The hashes in order of place, in hexadecimal digits."""
    return F.array_join(F.transform(selected, lambda p: F.lower(F.hex(pick_hash(p) + (1 << 32)))), " ")


def spliced(a: Column, a_bytes: Column, b: Column, b_bytes: Column, seam: Column, k: int = K) -> Column:
    """Picks of the first ``a_bytes`` of one text followed by the first ``b_bytes`` of another.

    Takes the picks of both whole texts; only windows across the seam are selected anew.
    ``seam`` holds the last bytes of the first part and the first of the second, at most
    ``guarantee - 1`` each.
    """
    reach = guarantee(k) - 1
    crossing = F.when(
        (b_bytes > 0) | (a_bytes <= reach),
        F.transform(picks(seam, k), lambda p: p - (a_bytes - F.least(a_bytes, F.lit(reach)))),
    ).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(
        picks_before(a, a_bytes - reach),
        crossing,
        F.transform(picks_before(b, b_bytes - reach), lambda p: p - a_bytes),
    ))


def with_next(
    rows: DataFrame, carried: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Each row with ``carried`` columns of the next one (``next_*``) by doc_id; the last gets the first.

    Null ids come first; rows of one id are in the order of their texts' hashes, then of their texts. The rows are
    cut into at most MOST_CELLS cells at quantiles of the ids, so that a far id makes no wide cell, and an id of
    very many rows, or the null, takes several cells by hash. A window works inside a cell; the first row of every
    cell (the heads, a bounded share of rows) is joined to the cell before it. ``derive`` adds columns row by row
    after the shuffle, so that they are not moved.
    """
    placed = rows.withColumn("place", F.coalesce(F.col(doc_id), F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64(text))
    celled = placed.withColumn("cell", _cell(rows.select(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("place"))))
    order = F.struct("place", "tie")
    starts = celled.groupBy("cell").agg(F.min(order).alias("start"))
    every = Window.partitionBy(F.lit(0))
    links = starts.select(
        "cell", "start.place", "start.tie",
        F.coalesce(F.lag("cell").over(every.orderBy("cell")), F.max("cell").over(every)).alias("before"),
    )
    # at most MOST_CELLS rows of four numbers
    first = celled.join(F.broadcast(links), ["cell", "place", "tie"]).select("before", *rows.columns)
    heads = (
        derive(first.withColumn("rank", F.row_number().over(Window.partitionBy("before").orderBy(text))).filter("rank = 1"))
        .select(F.col("before").alias("cell"), F.struct(*carried).alias("head"))
    )
    inside = Window.partitionBy("cell").orderBy("place", "tie", text)
    led = derive(celled.repartition("cell")).withColumn("led", F.lead(F.struct(*carried)).over(inside))
    joined = led.join(heads, "cell", "left").withColumn("then", F.coalesce("led", "head"))
    own = [c for c in led.columns if c not in ("cell", "place", "tie", "led")]
    return joined.select(*own, *(F.col(f"then.{c}").alias(f"next_{c}") for c in carried))


def _cell(places: DataFrame) -> Column:
    """The cell of a row by its ``place`` and ``tie``, ascending in both, from quantiles of the places."""
    n = places.count()
    cells = min(MOST_CELLS, max(1, n // ROWS_PER_CELL))
    if cells == 1:
        return F.lit(0)
    share = SEEN_PER_CELL * cells / n
    seen = places if share >= 1 else places.sample(share, 1)
    at = [i / cells for i in range(1, cells)]
    quantiles = seen.agg(F.percentile_approx("place", at, 4 * cells)).first()[0]
    if not quantiles:
        return F.lit(0)
    # one literal for the optimizer to fold, in place of one per bound
    bounds = F.split(F.lit(",".join(map(str, quantiles))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(cells.bit_length()))))

    def passed(test) -> Column:
        """How many bounds fulfil a test that only the first ones do, by binary search."""
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            test(F.get(bounds, at + step - 1)), at + step
        ).otherwise(at))

    place = F.col("place")
    below, upto = passed(lambda b: b < place), passed(lambda b: b <= place)
    part = F.shiftright("tie", 32) + (1 << 31)  # 0 to 2^32 - 1, ascending with the hash
    return (below + F.shiftright(part * (upto - below + 1), 32)).cast("int")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how like they and the next document are.

    The edited text has its last floor(n / 2) characters replaced by the first as many (or all) of
    the next document. Only (doc_id, text) are read and shuffled, once.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    pairs = with_next(rows, ["text", "picks"], lambda df: fingerprint(df, "text", k))
    n = F.char_length("text")
    reach = guarantee(k) - 1
    half = pairs.select(
        "doc_id", "picks", "next_picks", n.cast("long").alias("n_chars"),
        F.expr("left(text, char_length(text) - char_length(text) div 2)").alias("kept"),
        F.expr("left(next_text, cast(char_length(text) div 2 as int))").alias("added"),
    )
    a, b = F.octet_length("kept"), F.octet_length("added")
    tail = F.expr(f"substring(encode(kept, 'utf-8'), greatest(octet_length(kept) - {reach - 1}, 1), {reach})")
    head = F.expr(f"substring(encode(added, 'utf-8'), 1, {reach})")
    edited = half.select(
        "doc_id", "n_chars", "picks", "next_picks",
        F.sha2(F.concat("kept", "added"), 256).alias("edited_sha256"),
        spliced(F.col("picks"), a, F.col("next_picks"), b, F.concat(tail, head), k).alias("edited_picks"),
    )
    return edited.withColumns({
        "near_edited": likeness(F.col("picks"), F.col("edited_picks")),
        "near_next": likeness(F.col("picks"), F.col("next_picks")),
    })
