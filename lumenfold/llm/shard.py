"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined, then one exchange."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, utf8_crc32

KEY_BITS, STEP_BITS = 62, 8
#: Rows that one sorted range holds at most, about; a shard is made of so many ranges.
RANGE_ROWS = 500_000
#: Rows of an interval whose keys are read instead of probed.
FEW = 256
MAX_RANGES = 512


@dataclass
class _Splitter:
    target: float
    fixed: list = field(default_factory=list)  # values of the key columns settled so far
    prefix: int = 0
    bits: int = 0  # leading bits of the current key column in prefix
    bytes_below: int = 0  # of everything below the interval
    rows_below: int = 0
    key: tuple | None = None  # the boundary, when settled: rows with smaller keys are below it
    few: bool = False  # its interval holds few rows


def _settle(s: _Splitter, cells: list[tuple], whole: float, tolerance: float) -> None:
    """cells: (key, next key, bytes, rows) of the probes in the interval, in order. Moves the splitter into one of them or to one of its edges."""
    below, count = s.bytes_below, s.rows_below
    for low, high, size, n in cells:
        if below + size < s.target:
            below, count = below + size, count + n
            continue
        miss, s.key, s.rows_below = min((abs(below - s.target), low, count), (abs(below + size - s.target), high, count + n))
        if miss > tolerance and n > 1 and size > whole:
            s.key, s.bytes_below, s.rows_below = None, below, count
            s.fixed, s.prefix, s.bits, s.few = list(low[:-1]), low[-1], high[-1] - low[-1], n <= FEW
        return
    s.key, s.rows_below = cells[-1][1] if cells else (*s.fixed, s.prefix), count


def find_splitters(keys: DataFrame, columns: list[str], parts: int, tolerance: float, whole: float) -> list[tuple[tuple, int]]:
    """Boundaries that cut the bytes into equal parts: [(key, rows below)].

    A round counts, for the intervals that still hold a wanted boundary, exact bytes and rows of their 256
    sub-intervals: one partial aggregation, at most 256 rows an interval to the driver. Of an interval with at
    most FEW rows, the rows' keys come instead. `tolerance` is the error allowed, in bytes. Equal values of the
    first column are cut apart only if they are more than `whole` bytes.
    """
    total = keys.agg(F.sum("size"), F.count("*")).first()
    splitters = [_Splitter(total[0] * j / parts) for j in range(1, parts)] if total[1] else []
    while open_ := [s for s in splitters if s.key is None]:
        level, bits, few = min((len(s.fixed), s.bits, s.few) for s in open_)
        groups: dict[tuple, list[_Splitter]] = {}
        for s in open_:
            if (len(s.fixed), s.bits, s.few) == (level, bits, few):
                groups.setdefault((*s.fixed, s.prefix >> (KEY_BITS - bits)), []).append(s)
        here = KEY_BITS if few else min(bits + STEP_BITS, KEY_BITS)
        rows = keys
        for i in range(level):
            rows = rows.where(F.col(columns[i]).isin(sorted({k[i] for k in groups})))
        if bits:
            rows = rows.where(F.shiftright(columns[level], KEY_BITS - bits).isin(sorted({k[-1] for k in groups})))
        by = [F.col(c) for c in (columns if few else columns[:level])]
        probe = [] if few else [F.shiftright(columns[level], KEY_BITS - here).alias("probe")]
        found: dict[tuple, list] = {}
        for r in rows.groupBy(*by, *probe).agg(F.sum("size"), F.count("*")).collect():
            *key, size, n = r
            at = key[level] if few else key[level] << (KEY_BITS - here)
            found.setdefault((*key[:level], at >> (KEY_BITS - bits)), []).append(((*key[:level], at, *(key[level + 1 :] if few else ())), size, n))
        for g, members in groups.items():
            cells = sorted(found.get(g, []))
            step = 1 << (KEY_BITS - here)
            if few:
                # whole groups first, then single keys of a group that must be cut
                merged: dict[tuple, list] = {}
                for key, size, n in cells:
                    merged.setdefault(key[:1], []).append((key, size, n))
                wholes = [((k[0],), (k[0] + 1,), sum(x[1] for x in v), sum(x[2] for x in v)) for k, v in merged.items()] if level == 0 else []
                singles = [(key, (*key[:-1], key[-1] + 1), size, n) for key, size, n in cells]
                for s in members:
                    below, count = s.bytes_below, s.rows_below
                    if wholes:
                        _settle(s, wholes, whole, tolerance)
                    if s.key is None or not wholes:
                        s.bytes_below, s.rows_below, s.fixed = below, count, []
                        _settle(s, singles, float("inf"), tolerance)
            else:
                probes = [(key, (*key[:-1], key[-1] + step), size, n) for key, size, n in cells]
                for s in members:
                    _settle(s, probes, whole if level == 0 and here == KEY_BITS else -1, tolerance)
                    if s.key is None:
                        s.bits = here
                        if here == KEY_BITS:
                            if level + 1 == len(columns):  # rows whose whole key is one
                                s.key = (*s.fixed, s.prefix)
                            else:
                                s.fixed, s.prefix, s.bits, s.few = [*s.fixed, s.prefix], 0, 0, s.few
    return [(s.key, s.rows_below) for s in splitters]


def _below(columns: list[Column], key: tuple) -> Column:
    """Whether the row's key is under the boundary; missing trailing parts of the boundary count as lowest."""
    test = F.lit(False)
    for c, k in reversed(list(zip(columns, key, strict=False))):
        test = (c < F.lit(k)) | ((c == F.lit(k)) & test)
    return test


def _range_of(columns: list[Column], splitters: list[tuple], first: int = 0) -> Column:
    if not splitters:
        return F.lit(first)
    mid = len(splitters) // 2
    return F.when(_below(columns, splitters[mid]), _range_of(columns, splitters[:mid], first)).otherwise(_range_of(columns, splitters[mid + 1 :], first + mid + 1))


def histogram_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, tolerance: float = 0.001, whole_limit: float = 0.1) -> DataFrame:
    """Cut documents into shards of near equal bytes, sorted by a hash of the text.

    Returns the carried columns (default: all) with size, text_crc32, shard and slot (gapless from 0 in a shard).
    Documents with equal texts have one hash and stay in one shard, unless the group has more than `whole_limit`
    of a shard's bytes and lies on a boundary: then it is cut by id, so that a hot group can't unbalance the
    shards. Repeated rows are cut by a row number written beforehand.
    Null text: size 1, CRC-32 of nothing (0), one group. Null ids are allowed. Empty table: empty result.
    """
    carry = docs.columns if carry is None else carry
    text = docs[text_col]
    # probes are leading bits of the key, so keys are unsigned 62-bit numbers
    unsigned = lambda c: F.shiftrightunsigned(c, 64 - KEY_BITS)
    own = [c for c in carry if c.lower() not in {"size", "text_crc32", "shard", "slot"}]
    keys = materialize(
        docs.select(
            F.struct(F.lit(0).alias("_"), *[docs[c] for c in own]).alias("_carry"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            utf8_crc32(text).alias("text_crc32"),
            unsigned(F.xxhash64(text)).alias("_k1"),
            unsigned(F.xxhash64(docs[id_col])).alias("_k2"),
            unsigned(F.xxhash64(F.monotonically_increasing_id())).alias("_k3"),
        ),
        "shard-keys",
    )
    columns = ["_k1", "_k2", "_k3"]
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    pieces = max(1, min(MAX_RANGES // shards or 1, -(-rows // (shards * RANGE_ROWS))))
    share = total / shards
    found = find_splitters(keys, columns, shards * pieces, tolerance * share, whole_limit * share)
    starts = [0, *[n for _, n in found]]
    starts += [rows] * (shards * pieces - len(starts))
    offset = [starts[i] - starts[i - i % pieces] for i in range(shards * pieces)]
    ranged = keys.withColumn("_range", _range_of([F.col(c) for c in columns], [k for k, _ in found]))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*columns))
    slot = F.element_at(F.array(*[F.lit(int(x)) for x in offset]), F.col("_range") + 1).cast("long") + at - 1
    return ranged.withColumn("shard", F.floor(F.col("_range") / pieces).cast("int")).select(*[F.col("_carry").getField(c).alias(c) for c in own], "size", "text_crc32", "shard", slot.alias("slot"))
