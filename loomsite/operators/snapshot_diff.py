"""What changed between consecutive full snapshots, by subtracting invertible Bloom lookup tables."""

from __future__ import annotations

import struct

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsite.plans.stage import bounded, is_empty, stage

#: Records of one side that one bucket should hold.
BUCKET_ROWS = 256
#: Cells of each of the three subtables of a bucket in the first attempt; each further attempt takes four times as many.
SUBTABLE_CELLS = 32
#: Attempts before the buckets that are left are compared record by record.
ATTEMPTS = 4
_BITS = 20  # bits of the element hash that choose the cell in one subtable
_MASK = (1 << 64) - 1


def current_state(history: DataFrame, group: str, version: str, key: str, delivered: str, values: list[str]) -> DataFrame:
    """One row per (group, version, key): the latest delivery, with 64-bit hashes of the key and of its values.

    Values are compared without surrounding blanks and in lower case; null is a value of its own. The key loses
    trailing slashes. Rows in which group, version or key is null are left out; of equally late deliveries the one
    with the larger value hash counts, a missing delivery time counts as the earliest.
    """
    norm = [F.coalesce(F.concat(F.lit("v"), F.lower(F.trim(F.col(v)))), F.lit("n")) for v in values]
    rows = history.select(
        F.col(group).alias("grp"), F.col(version).alias("ver"), F.regexp_replace(F.col(key), "/+$", "").alias("item"),
        F.struct(F.col(delivered).alias("at"), F.xxhash64(*norm).alias("val")).alias("last"),
    ).filter("grp is not null and ver is not null and item is not null")
    return rows.groupBy("grp", "ver", "item").agg(F.max("last").alias("last")).select("grp", "ver", "item", F.xxhash64("item").alias("key"), F.col("last.val").alias("val"))


def _versions(state: DataFrame) -> DataFrame:
    """Each version with its neighbours; buckets of a version pair by the larger of its two sides."""
    w = Window.partitionBy("grp").orderBy("ver")
    n = state.groupBy("grp", "ver").agg(F.count("*").alias("n"))
    buckets = F.greatest(F.lit(1), F.ceil(F.greatest("n", F.lag("n").over(w)) / BUCKET_ROWS))
    n = n.withColumns({"prev": F.lag("ver").over(w), "next": F.lead("ver").over(w), "nb": buckets})
    return n.select("grp", "ver", "prev", "next", "nb", F.lead("nb").over(w).alias("next_nb"))


def _signed(state: DataFrame, versions: DataFrame) -> DataFrame:
    """Every record once for the pair that ends at its version (+1) and once for the pair that begins there (-1)."""
    sides = F.array(F.struct(F.col("ver").alias("pair"), F.lit(1).alias("sign"), F.col("nb").alias("nb"), F.col("prev").alias("other")), F.struct(F.col("next").alias("pair"), F.lit(-1).alias("sign"), F.col("next_nb").alias("nb"), F.col("ver").alias("other")))
    rows = state.join(versions, ["grp", "ver"]).select("grp", "key", "val", F.xxhash64("key", "val").alias("chk"), F.explode(sides).alias("s"))
    rows = rows.filter("s.pair is not null and s.other is not null")
    return rows.select("grp", F.col("s.pair").alias("pair"), F.pmod(F.xxhash64("key", F.lit(7)), F.col("s.nb")).alias("bucket"), F.col("s.sign").alias("sign"), "key", "val", "chk")


def _cells(signed: DataFrame, size: int) -> DataFrame:
    """Per bucket the subtracted table: signed count and exclusive-or sums of each touched cell; cell -1 is the digest."""
    places = [F.lit(-1).cast("bigint")] + [F.pmod(F.shiftrightunsigned("chk", _BITS * j).bitwiseAND((1 << _BITS) - 1), F.lit(size)) + j * size for j in range(3)]
    at = signed.withColumn("cell", F.explode(F.array(*places)))
    other = F.when(F.col("cell") < 0, F.xxhash64("val", "key")).otherwise(F.col("chk"))
    cells = at.groupBy("grp", "pair", "bucket", "cell").agg(F.sum("sign").alias("n"), F.bit_xor("key").alias("k"), F.bit_xor("val").alias("v"), F.bit_xor(other).alias("c"))
    return cells.filter("n <> 0 or k <> 0 or v <> 0 or c <> 0").groupBy("grp", "pair", "bucket").agg(F.collect_list(F.struct("cell", "n", "k", "v", "c")).alias("cells"))


def _hash(a: int, b: int) -> int:
    """Spark's xxhash64 of two longs, unsigned."""
    return xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))


def _signed64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def peel(cells: list[tuple[int, int, int, int, int]], size: int) -> list[tuple[int, int, int]] | None:
    """The elements (key, value, sign) of a subtracted table of three subtables; None if it can't be emptied or the digest differs."""
    t = {c: [n, k & _MASK, v & _MASK, x & _MASK] for c, n, k, v, x in cells}
    digest = t.pop(-1, [0, 0, 0, 0])
    todo, found = list(t), []
    while todo:
        cell = t.get(todo.pop())
        if not cell or abs(cell[0]) != 1:
            continue
        n, k, v, x = cell
        key, val = _signed64(k), _signed64(v)
        if _hash(key, val) != x:
            continue
        found.append((key, val, n))
        for j in range(3):
            at = ((x >> (_BITS * j)) & ((1 << _BITS) - 1)) % size + j * size
            c = t.setdefault(at, [0, 0, 0, 0])
            c[0] -= n
            c[1] ^= k
            c[2] ^= v
            c[3] ^= x
            if any(c):
                todo.append(at)
            else:
                del t[at]
    if t:
        return None
    check = [0, 0, 0, 0]
    for key, val, n in found:
        check = [check[0] + n, check[1] ^ (key & _MASK), check[2] ^ (val & _MASK), check[3] ^ _hash(val, key)]
    return found if check == digest else None


def _peeled(cells: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for g, p, b, cs in zip(pdf.grp, pdf.pair, pdf.bucket, pdf.cells):
                got = peel([(c["cell"], c["n"], c["k"], c["v"], c["c"]) for c in cs], size)
                rows += [(g, p, b, None, None, None)] if got is None else [(g, p, b, k, v, s) for k, v, s in got]
            yield pd.DataFrame(rows, columns=["grp", "pair", "bucket", "key", "val", "sign"], dtype=object).astype({"bucket": "int64", "key": "Int64", "val": "Int64", "sign": "Int32"})

    kinds = dict(cells.dtypes)
    return cells.mapInPandas(run, f"grp {kinds['grp']}, pair {kinds['pair']}, bucket bigint, key bigint, val bigint, sign int")


def snapshot_changes(history: DataFrame, group="domain", version="snapshot_id", key="url", delivered="delivered_at", values=("title_hash", "paragraph_hash"), cells=SUBTABLE_CELLS, attempts=ATTEMPTS) -> DataFrame:
    """(group, version, key, status): records added, removed or changed from each version of a group to its next one.

    Records are spread over hash buckets and summed into one subtracted table per bucket; differing elements are
    peeled from it and checked against the bucket's digest. Buckets that can't be peeled are built again with larger
    tables; what is left after `attempts` is compared record by record, so the result is whole for any rate of change.
    A group's first version yields nothing; an empty table gives an empty result. Columns beyond those named are ignored.
    """
    state = stage(current_state(history, group, version, key, delivered, list(values)), "state")
    versions = bounded(stage(_versions(state), "versions"))
    signed = todo = _signed(state, versions)
    parts = []
    for attempt in range(attempts):
        size = cells * 4**attempt
        got = stage(_peeled(_cells(todo, size), size), f"peeled{attempt}")
        parts.append(got.filter("key is not null").select("grp", "pair", "key", "sign"))
        failed = got.filter("key is null").select("grp", "pair", "bucket")
        if is_empty(failed):
            break
        todo = signed.join(failed, ["grp", "pair", "bucket"], "left_semi")
    else:
        left = todo.groupBy("grp", "pair", "key", "val").agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
        parts.append(left.select("grp", "pair", "key", "sign"))
    diff = parts[0]
    for p in parts[1:]:
        diff = diff.unionByName(p)
    status = F.when(F.count_if(F.col("sign") > 0) == 0, "removed").when(F.count_if(F.col("sign") < 0) == 0, "added").otherwise("changed")
    diff = diff.groupBy("grp", "pair", "key").agg(status.alias("status"))
    diff = diff.join(versions.select("grp", F.col("ver").alias("pair"), "prev"), ["grp", "pair"]).withColumn("ver", F.when(F.col("status") == "removed", F.col("prev")).otherwise(F.col("pair")))
    named = diff.join(state.select("grp", "ver", "key", "item"), ["grp", "ver", "key"])
    return named.select(F.col("grp").alias(group), F.col("pair").alias(version), F.col("item").alias(key), "status")
