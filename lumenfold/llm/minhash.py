"""MinHash near-duplicate detection: universal hash minima, banding, signature and exact verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, build
from .common import discard, materialize, ship
from .components import connected_components

#: A pair at 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 1.3e-7.
BANDS, ROWS = 40, 5
#: Share of agreeing minima below which a candidate is dropped; at a similarity of 0.8 that is 7 deviations away.
SIGNATURE_LEAST = 0.6
#: Members of a band that are held against each other one by one; larger ones are joined by their rarest shingles.
CROWD = 64
#: Salts over which a class of equal sets is spread, and counters of the sketch of shingle frequencies.
SALTS, COUNTERS = 16, 1 << 20
_WORDS = 120_000  # entries of a task's cache of word hashes


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes. bytes.lower() and bytes.split() know ASCII alone, as asked."""

    def __init__(self, words: int):
        self.words, self.cache = words, {}
        rng = np.random.default_rng(11)
        self.factors = rng.integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint64)
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.empty(0, dtype=np.uint64)
        if len(tokens) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(tokens))], dtype=np.uint64)
        cache = self.cache
        try:
            ids = list(map(cache.__getitem__, tokens))
        except KeyError:
            if len(cache) > _WORDS:
                cache.clear()
            for t in tokens:
                if t not in cache:
                    cache[t] = xxhash.xxh3_64_intdigest(t)
            ids = list(map(cache.__getitem__, tokens))
        h = np.array(ids, dtype=np.uint64)
        n = len(h) - self.words + 1
        out = np.zeros(n, dtype=np.uint64)
        for k, f in enumerate(self.factors):
            part = h[k : k + n]
            out = (out ^ (part >> np.uint64(29))) * f + part
        out ^= out >> np.uint64(32)
        out *= self.factors[0]
        out ^= out >> np.uint64(29)
        return np.unique(out)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every hash function, (a * x + b) mod 2^64 >> 32, its minimum over the shingles."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 256):
        block = shingles[start : start + 256]
        np.minimum(low, (block[:, None] * a[None, :] + b[None, :]).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (a, b) = Shingler(words), _multipliers(bands * rows)
        for batch in batches:
            n, prints, sketches, keys = [], [], [], []
            for text in batch.column(1):
                s = shingler(text.as_py())
                n.append(len(s))
                if not len(s):
                    prints.append(None), sketches.append(None), keys.append(None)
                    continue
                low = minima(s, a, b)
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketches.append((low & np.uint32(255)).astype(np.uint8).tobytes())
                banded = low.reshape(bands, rows)
                keys.append([xxhash.xxh3_64_intdigest(banded[i].tobytes(), seed=i) - (1 << 63) for i in range(bands)])
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "print", "sketch", "keys"])

    return run


def _agree(threshold: float):
    """Keeps candidates whose sketches agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            same = (x == y).mean(axis=1)
            keep = pa.array((same - 1 / 256) / (1 - 1 / 256) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def _sets(words: int, wanted: Bloom):
    """The shingle sets of rows whose id may be wanted; of rows that repeat one set, a task's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in batches:
            ids, sets = [], []
            for i in np.flatnonzero(wanted.test(batch.column(0).to_numpy())):
                key, text = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if (key, hash(text)) not in seen:
                    seen.add((key, hash(text)))
                    ids.append(key), sets.append(shingler(text).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(1).type), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _shared_keys(shared: Bloom):
    """(id, n, key) for the keys that another row may have as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                keys = part.column(2)
                flat, rows = keys.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(part.num_rows), keys.value_lengths().to_numpy())
                hit = shared.test(flat) if len(flat) else np.empty(0, dtype=bool)
                at = pa.array(rows[hit])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(flat[hit], pa.int64())], ["id", "n", "key"])

    return run


def _wanted(wanted: Bloom):
    """Rows whose first column's hash may be wanted, without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(wanted.test(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays(kept.columns[1:], batch.schema.names[1:])

    return run


def _confirm(numerator: int, denominator: int):
    """Keeps pairs with denominator * intersection >= numerator * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(denominator * both >= numerator * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return run


def _similar_size(a: Column, b: Column, numerator: int, denominator: int) -> Column:
    return (F.lit(denominator) * F.least(a, b)) >= (F.lit(numerator) * F.greatest(a, b))


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, count) of the sets' shingles, a task's together."""
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for s in batch.column(0):
            counts += np.bincount(_bucket(np.frombuffer(s.as_buffer(), dtype=np.uint64)), minlength=COUNTERS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "count"])


def prefix_lengths(n: int, numerator: int, denominator: int) -> tuple[int, int]:
    """(to probe, to index): of two sets that are similar enough, in any one order of all shingles, the larger one's first
    and the smaller one's first so many have one in common: they share numerator / denominator of the larger, and
    2 * numerator / (numerator + denominator) of the smaller."""
    probe = n - -(-numerator * n // denominator) + 1
    return probe, n - -(-2 * numerator * n // (numerator + denominator)) + 1


def _prefixes(counts: np.ndarray, numerator: int, denominator: int):
    """(id, part, n, shingle, indexed): each set's rarest shingles, as many as a similar one must share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                rows, sizes, keys, marks = [], [], [], []
                for i, x in enumerate(part.column(2)):
                    x = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                    probe, index = prefix_lengths(len(x), numerator, denominator)
                    first = x[np.lexsort((x, counts[_bucket(x)]))[:probe]]
                    rows.append(np.full(len(first), i)), sizes.append(np.full(len(first), len(x)))
                    keys.append(first.view(np.int64)), marks.append(np.arange(len(first)) < index)
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(marks))], ["id", "part", "n", "shingle", "indexed"])

    return run


class _Verifier:
    """Signature check, then the exact one: texts of candidates alone are read and shingled again."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, words: int, numerator: int, denominator: int, repeated: bool):
        self.docs, self.sketches, self.words, self.ratio, self.repeated = docs, sketches, words, (numerator, denominator), repeated
        self.kind = docs.schema["id"].dataType.simpleString()

    def __call__(self, pairs: DataFrame) -> DataFrame:
        kind = self.kind
        pairs = materialize(pairs.distinct(), "candidates")
        few = self._asked(pairs)
        s = materialize(self.sketches.select(F.xxhash64("id").alias("h"), "id", "n", "sketch").mapInArrow(_wanted(few), f"id {kind}, n bigint, sketch binary"), "asked")
        left = s.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
        right = s.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
        joined = pairs.join(left, "u").join(right, "v").where(_similar_size(F.col("nu"), F.col("nv"), *self.ratio))
        likely = materialize(joined.select("u", "v", "su", "sv").mapInArrow(_agree(SIGNATURE_LEAST), f"u {kind}, v {kind}"), "likely")
        sets = self.sets(likely.select(F.col("u").alias("id")).unionByName(likely.select(F.col("v").alias("id"))))
        full = likely.join(sets.select(F.col("id").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("y")), "v")
        links = materialize(full.select("u", "v", "x", "y").mapInArrow(_confirm(*self.ratio), f"u {kind}, v {kind}").distinct(), "links")
        for t in (pairs, s, likely, sets):
            discard(t)
        return links

    def _asked(self, pairs: DataFrame) -> Bloom:
        return self._filter(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))))

    def _filter(self, ids: DataFrame) -> Bloom:
        hashes = ids.distinct().select(F.xxhash64("id").alias("h"))
        return build(hashes, hashes.count())

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, set) of these ids' rows, and perhaps a few others, one for each id and set."""
        found = materialize(self.docs.select(F.xxhash64("id").alias("h"), "id", "text").mapInArrow(_sets(self.words, self._filter(ids)), f"id {self.kind}, set binary"), "sets")
        if not self.repeated:
            return found
        once = materialize(found.groupBy("id", F.xxhash64("set").alias("h")).agg(F.first("set").alias("set")).select("id", "set"), "sets")
        discard(found)
        return once

    def crowd(self, members: DataFrame) -> DataFrame:
        """(u, v) candidates among the members (id, part) of crowded bands, of different parts: all pairs that are similar enough are there.

        Of two such sets, in any one order of all shingles, the first few of either have one in common. With rare ones first,
        what all members share, and what made them a crowd, is not among them, so a crowd of texts that differ meets
        about as few others as any text. The order is by counts in a sketch of fixed size: a worse one costs time,
        never a pair.
        """
        kind = self.kind
        sets = self.sets(members.select("id"))
        sets_ = materialize(sets.join(members, "id").select("id", "part", "set"), "crowd")
        discard(sets)
        found = sets_.select("set").mapInArrow(_frequencies, "bucket bigint, count bigint").groupBy("bucket").agg(F.sum("count").alias("count")).toPandas()  # COUNTERS rows at most
        counts = np.zeros(COUNTERS, dtype=np.int64)
        counts[found["bucket"].to_numpy(dtype=np.int64)] = found["count"].to_numpy(dtype=np.int64)
        rows = materialize(sets_.mapInArrow(_prefixes(counts, *self.ratio), f"id {kind}, part {kind}, n bigint, shingle bigint, indexed boolean"), "prefixes")
        x, y = rows.alias("x"), rows.where("indexed").alias("y")
        smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.id") < F.col("x.id")))
        met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & smaller & (F.col("x.part") != F.col("y.part")) & (F.col("x.id") != F.col("y.id")) & _similar_size(F.col("x.n"), F.col("y.n"), *self.ratio))
        pairs = materialize(met.select(F.greatest("x.id", "y.id").alias("u"), F.least("x.id", "y.id").alias("v")).distinct(), "met")
        for t in (sets_, rows):
            discard(t)
        return pairs


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, numerator: int = 80, denominator: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs: near-duplicate groups by word shingles.

    A-Z are lower-cased, ASCII white space separates words, a text of fewer words than a shingle is one shingle,
    null and blank texts have none and link with nothing. Texts link when
    denominator * |intersection| >= numerator * |union|, confirmed on the full sets of 64-bit shingle hashes.

    Equal sets become one class first, whatever their number. Candidates share a band of minima. A band's members
    are first held against its smallest id alone; those links give components, and only members of a band that
    are then still apart, and near enough in size, are held against each other: in a band of CROWD such members or
    fewer one by one, in a larger one where their rarest shingles meet. So a group of thousands, alike or not, costs
    a number of comparisons in proportion to it, and no link that a band proposes is lost.
    Null ids get a null component. Rows that repeat an id with different texts: the id links by any of them. Of
    ties the smallest id stands for its class. Very long texts are read whole, one at a time. Extra columns are left out;
    an empty table gives none.
    """
    ship(docs.sparkSession)
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    table = materialize(docs.mapInArrow(_sketch(words, bands, rows), f"id {kind}, n bigint, print binary, sketch binary, keys array<bigint>"), "minhash")
    known = table.where("id is not null and n > 0")
    # one row for a class: its smallest id's, folded before the exchange
    reps = known.groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min_by(F.struct("n", "sketch", "keys"), "id").alias("s"))
    sketches = materialize(reps.select("id", "s.n", "s.sketch", "s.keys", "print", "copies"), "sketches")
    # classes of several rows, each under several keys, so that a hot one is no hot key
    several = sketches.where("copies > 1").select("print", F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = known.select("id", "print", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    member = materialize(salted.join(several, ["print", "salt"]).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct(), "classes")
    shared = sketches.select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    shared = materialize(shared.where("first <> last").select("key", "first"), "bands")
    links, done = member, [sketches, member, shared]
    if count := shared.count():
        few = build(shared.select("key"), count)
        banded = materialize(sketches.select("id", "n", "keys").mapInArrow(_shared_keys(few), f"id {kind}, n bigint, key bigint").join(shared, "key"), "banded")
        repeated = bool(known.groupBy("id").count().where("count > 1").limit(1).count())
        verify = _Verifier(docs, sketches.select("id", "n", "sketch"), words, numerator, denominator, repeated)
        found = verify(banded.where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")))
        parts = materialize(connected_components(found), "parts")
        # the first of a band has been held against all others
        apart = banded.where("id <> first").join(parts, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("part")).dropDuplicates(["key", "id"])
        mixed = apart.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("m")).where("a <> b").select("key", "m")
        apart = materialize(apart.join(mixed, "key"), "apart")
        done += [banded, found, parts, apart]
        links = links.unionByName(found)
        if apart.limit(1).count():
            x, y = apart.where(F.col("m") <= CROWD).alias("x"), apart.where(F.col("m") <= CROWD).alias("y")
            more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & _similar_size(F.col("x.n"), F.col("y.n"), numerator, denominator))
            more = more.select(F.col("x.id").alias("u"), F.col("y.id").alias("v"))
            crowded = materialize(apart.where(F.col("m") > CROWD).select("id", "part").distinct(), "crowded")
            done.append(crowded)
            if crowded.limit(1).count():
                met = verify.crowd(crowded)
                done.append(met)
                more = more.unionByName(met)
            extra = verify(more)
            done.append(extra)
            links = links.unionByName(extra)
    # ids of a class link with its representative; one pass gives the components of all rows
    groups = connected_components(links)
    for t in done:
        discard(t)
    return table.select("id", F.col("n").alias("n_shingles")).join(groups, table["id"] == groups["node"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the smallest id.

    Rows without an id belong to no group and stay. Rows that repeat an id are rows by themselves, in order of their
    texts: one goes if its own text links, with that id's or another's.
    """
    known = docs.where(docs[id_col].isNotNull())
    if known.groupBy(id_col).count().where("count > 1").limit(1).count():
        # row numbers in order of ids and texts; written, so that they hold
        numbered = known.orderBy(F.col(id_col), F.col(text_col).asc_nulls_last()).withColumn("_lumenfold_row", F.monotonically_increasing_id())
        known, by = materialize(numbered, "rows"), "_lumenfold_row"
    else:
        known, by = docs, id_col
    found = minhash_components(known, by, text_col, words, numerator, denominator)
    dropped = found.where("id <> component_id").select(F.col("id").alias("_gone")).distinct()
    kept = known.join(dropped, known[by] == dropped["_gone"], "left_anti")
    return kept if by == id_col else kept.drop(by).unionByName(docs.where(docs[id_col].isNull()))
