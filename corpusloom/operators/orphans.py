"""References to pages that are missing, deleted or came later.

Method: page keys are dictionary-encoded as integers; references and live pages become compressed bitmaps per key
range and month; reference AND-NOT parent leaves the orphans, and the bits that survive are decoded back to links.

* The dictionary is built by one aggregation over page rows and referenced paths, hashed by path. Ids are
  (partition << 33) + position in key order, so a range of ids lies in one partition and a task only
  builds bitmaps of its own ranges.
* The only per-row work is one join by path to get the ids. Paths that hold over 1/64 of the references (an entry
  page) are salted.
* A range's bitmaps over all months are a few hundred KB at most, whatever the size of the data.

Cases: null ``from_path``/``to_ref``, refs without a slash, external refs and relative refs without a ``from_path`` are
no references. An empty table of pages makes every reference ``missing``; an empty table of links gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.skew import SALTS, hot_keys, salt_of
from corpusloom.session import stored

BITS = 32768  # of one bitmap_construct_agg bitmap
SPARSE = 2048  # up to so many set bits a container holds 16-bit positions, else the bitmap itself


def is_page_ref(ref: Column) -> Column:
    """A reference with a slash or backslash and without a scheme."""
    return ref.isNotNull() & ref.rlike(r"[/\\]") & ~F.trim(ref).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def resolve_ref(ref: Column, from_path: Column, brain_id: Column) -> Column:
    """The repository path that ``ref`` names, or null if it can't be resolved.

    Anchors are cut before unescaping; ``+`` is no blank; odd slashes, ``.`` and ``..`` are resolved; ``.md`` is added.
    """
    bare = F.trim(F.split_part(F.trim(F.translate(ref, "\\", "/")), F.lit("#"), F.lit(1)))
    plain = F.when(bare.contains("%"), F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)).otherwise(bare)
    plain = F.trim(plain)
    folder = F.regexp_replace(from_path, r"[^/]*$", "")
    rooted = (
        F.when(plain.rlike(r"^/*brains/"), plain)
        .when(plain.rlike(r"^/*sources/"), F.concat(F.lit("brains/"), brain_id, F.lit("/"), plain))
        .otherwise(F.concat(folder, plain))
    )
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc).when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).otherwise(F.concat(acc, F.lit("/"), x))
    )
    walked = F.substring(F.aggregate(F.split(rooted, "/"), F.lit(""), step), 2, 1_000_000)
    clean = F.when(rooted.rlike(r"//|^/|/\.|^\."), walked).otherwise(rooted)
    return F.when(clean.endswith(".md"), clean).otherwise(F.concat(clean, F.lit(".md")))


def _short(id_: Column) -> Column:
    """An id as bytes: a hash in lower-case hex takes half the room on its way through shuffles."""
    return F.when(id_.rlike("^([0-9a-f]{2})+$"), F.concat(F.lit(b"h"), F.unhex(id_))).otherwise(F.concat(F.lit(b"t"), F.encode(id_, "utf-8")))


def _long(short: Column) -> Column:
    body = F.substring(short, 2, 1_000_000)
    return F.when(F.substring(short, 1, 1) == F.lit(b"h"), F.lower(F.hex(body))).otherwise(F.decode(body, "utf-8"))


def page_references(links: DataFrame) -> DataFrame:
    """(id, side, path, synced_at): the page references of every link, ids (as bytes) once with their earliest synced_at."""
    to = F.when(is_page_ref(F.col("to_ref")), resolve_ref(F.col("to_ref"), F.col("from_path"), F.col("brain_id")))
    first = links.select(_short(F.col("id")).alias("id"), F.struct("synced_at", F.col("from_path").alias("from"), to.alias("to")).alias("_r"))
    one = first.groupBy("id").agg(F.min("_r").alias("_r"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col("_r")[s].alias("path")) for s in ("from", "to")]))
    return one.select("id", F.col("_r.synced_at").alias("synced_at"), sides.alias("_s")).select("id", "synced_at", "_s.side", "_s.path").where(F.col("path").isNotNull())


def _month(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def key_dictionary(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, kid, exists, archived, first_at, n): one integer id per page path or referenced path, and what is known of the page."""
    status = F.lower(F.trim("status"))
    seen = pages.where(F.col("path").isNotNull()).select("path", F.struct("updated_at", status.alias("status")).alias("_v"), "updated_at", F.lit(0).alias("_ref"))
    asked = refs.select("path", F.lit(None).cast(seen.schema["_v"].dataType).alias("_v"), F.lit(None).cast(seen.schema["updated_at"].dataType).alias("updated_at"), F.lit(1).alias("_ref"))
    keys = seen.unionByName(asked).groupBy("path").agg(
        (F.min("_ref") == 0).alias("exists"), F.coalesce(F.max("_v")["status"] == "archived", F.lit(False)).alias("archived"), F.min("updated_at").alias("first_at"), F.sum("_ref").alias("n")
    )
    return stored(keys.sortWithinPartitions("path").withColumn("kid", F.monotonically_increasing_id()))


@F.pandas_udf(T.BinaryType())
def _pack(bitmaps: pd.Series) -> pd.Series:
    def one(b: bytes) -> bytes:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little"))
        return b"p" + at.astype("<u2").tobytes() if len(at) <= SPARSE else b"b" + b

    return bitmaps.map(one)


def _unpack(container: bytes) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    if container[:1] == b"p":
        bits[np.frombuffer(container[1:], "<u2")] = True
    else:
        raw = np.unpackbits(np.frombuffer(container[1:], np.uint8), bitorder="little").astype(bool)
        bits[: len(raw)] = raw
    return bits


def bitmaps(df: DataFrame, what: Column, month: Column) -> DataFrame:
    """(range, what, month, bits): compressed bitmaps of ``kid``, one per key range and month."""
    made = df.groupBy(F.shiftright("kid", 15).alias("range"), what.alias("what"), month.alias("month")).agg(F.bitmap_construct_agg(F.col("kid").bitwiseAND(F.lit(BITS - 1))).alias("bits"))
    return made.withColumn("bits", _pack("bits"))


def _and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: references of a month AND-NOT the pages that were live before that month, split by kind."""
    t = pa.Table.from_batches(list(batches)).to_pylist()
    if not t:
        return
    base = t[0]["range"] << 15
    none = np.zeros(BITS, bool)
    known, gone, live = none.copy(), none.copy(), {}
    for r in t:
        if r["what"] == "known":
            known |= _unpack(r["bits"])
        elif r["what"] == "gone":
            gone |= _unpack(r["bits"])
        elif r["what"] == "live":
            live[r["month"]] = live.get(r["month"], none) | _unpack(r["bits"])
    before, months, rows = none.copy(), sorted(live), {"kid": [], "month": [], "kind": []}
    for r in sorted((r for r in t if r["what"] == "ref"), key=lambda r: r["month"]):
        while months and months[0] < r["month"]:
            before |= live[months.pop(0)]
        left = _unpack(r["bits"]) & ~before
        for kind, bits in (("missing", left & ~known), ("deleted", left & gone), ("late", left & known & ~gone)):
            at = np.flatnonzero(bits)
            rows["kid"].append(at + base)
            rows["month"].append(np.full(len(at), r["month"]))
            rows["kind"].append(np.full(len(at), kind, dtype=object))
    if rows["kid"]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows["kid"]), pa.int64()), pa.array(np.concatenate(rows["month"]), pa.int32()), pa.array(np.concatenate(rows["kind"]), pa.string())], names=["kid", "month", "kind"])


def orphan_references(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, side, kind, synced_at): kind is missing, deleted or late; see the module."""
    refs = stored(page_references(links))
    keys = key_dictionary(refs, pages)
    hot = hot_keys(keys, "path", "n")
    paths = keys.withColumn("_salt", F.explode(F.when(F.col("path").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))) if hot else keys.withColumn("_salt", F.lit(0))
    coded = stored(
        refs.withColumn("_salt", salt_of("path", F.col("id"), hot))
        .join(paths.select("path", "_salt", "kid", "first_at"), ["path", "_salt"])
        .select("id", "side", "synced_at", "kid", "_salt", F.coalesce(_month(F.col("synced_at")), F.lit(-1)).alias("month"), "first_at")
    )
    zero = F.lit(0)
    marks = (
        bitmaps(coded, F.lit("ref"), F.col("month"))
        .unionByName(bitmaps(keys.where("exists"), F.lit("known"), zero))
        .unionByName(bitmaps(keys.where("archived"), F.lit("gone"), zero))
        .unionByName(bitmaps(keys.where("exists and not archived and first_at is not null"), F.lit("live"), _month(F.col("first_at"))))
    )
    left = marks.groupBy("range").applyInArrow(_and_not, "kid long, month int, kind string")
    salts = F.array_distinct(F.array(zero, *[F.lit(i) for i in range(1, SALTS)])) if hot else F.array(zero)
    hot_ids = [r[0] for r in keys.where(F.col("path").isin(hot)).select("kid").collect()] if hot else []
    left = left.withColumn("_salt", F.explode(F.when(F.col("kid").isin(hot_ids), salts).otherwise(F.array(zero)) if hot else F.array(zero)))
    found = coded.join(left, ["kid", "month", "_salt"])
    # within one month the bitmaps can't tell which came first
    return found.where((F.col("kind") != "late") | (F.col("first_at") > F.col("synced_at"))).select(_long(F.col("id")).alias("id"), "side", "kind", "synced_at")


def orphan_report(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts per referring table, side, kind and month of synced_at."""
    found = orphan_references(links, pages)
    return found.groupBy(F.lit("links").alias("from_table"), "side", "kind", F.date_format("synced_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
