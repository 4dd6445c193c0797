"""Conversations rebuilt from message rows.

Sessionising: messages of a session are sorted by instant, and a gap of over GAP_S between a user's message and the next
user's message means that the first got no reply. Sessions without reciprocal replies, with unknown roles or with holes
in their numbering are dropped.

A session may hold a third of all rows, so no window ever spans a whole session:
* numbering is checked by aggregation; a valid session has turns 1..n, which splits it into blocks of BLOCK turns;
* missing instants are filled within a block, then carried over blocks;
* order by instant is by buckets, cut at quantiles for sessions of over BLOCK messages; a bucket edge that many messages
  share is a bucket of its own, split by turn;
* each bucket is summed up (first and last speaker, gaps), and the summaries are put in sequence.

Cases: a null session_id leaves the row out; of rows with the same session and turn the least turn_id stays; a null turn
or role drops the session; an unreadable ``at`` takes the instant before it by turn (a leading one sorts first and makes
no gap); blank messages are left out; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored

#: Inactivity in seconds after which a user's message lacks its reply. ``calibrated_gap`` measures it on a corpus.
GAP_S = 600
BLOCK = 4096
#: Cut points of sessions that exceed BLOCK.
CUTS = 1000
#: Parts into which the messages of one session are dealt before its cut points are known.
GAP_PARTS = 64
SPACE = r"[\s\p{Z}\p{Cc}\p{Cf}]"
MEMO = r"(?is)<[a-z]+-memory-context\b[^>]*>.*?</[a-z]+-memory-context>"
STAMP = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}([.,]\d+)?)?)?$"
ZONE = r"(Z|[+-]\d{1,2}:?\d{2})$"


def role_of(role: Column) -> Column:
    r = F.lower(F.regexp_replace(role, rf"^{SPACE}+|{SPACE}+$", ""))
    r = F.when(r == "human", "user").when(r.isin("ai", "bot"), "assistant").otherwise(r)
    return F.when(r.isin("user", "assistant", "system", "tool"), r)


def instant_of(at: Column) -> Column:
    """Microseconds since 1970 of any of the notations; null if unreadable. No zone means UTC, bare digits are milliseconds."""
    t = F.upper(F.trim(at))
    digits = F.when(t.rlike(r"^\d{1,15}$"), t.cast("long") * 1000)
    zone = F.regexp_extract(t, r"\d{1,2}:\d{2}\S*?\s*" + ZONE, 1)
    # a trailing -05 of a bare date is no zone: a zone follows a time of day
    body = F.when(zone != "", F.regexp_replace(t, ZONE, "")).otherwise(t)
    body = F.trim(F.translate(body, "/", "-"))
    zone = F.when((zone == "") | (zone == "Z"), F.lit("+00:00")).otherwise(F.regexp_replace(zone, r"^([+-])(\d{1,2}):?(\d{2})$", "$1$2:$3"))
    body = F.when(body.contains(":"), body).otherwise(F.concat(body, F.lit(" 00:00:00")))
    read = F.when(body.rlike(STAMP), F.concat(F.regexp_replace(body, ",", "."), zone).try_cast("timestamp"))
    # the common notation goes by one pattern, the others by the rest
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.unix_micros(t.try_cast("timestamp")))
    return F.coalesce(iso, digits, F.unix_micros(read))


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space, zero-width characters and memory-context blocks."""
    return ~F.coalesce(F.regexp_replace(text, MEMO, "").rlike(SPACE.replace("[", "[^", 1)), F.lit(False))


def _messages(turns: DataFrame) -> DataFrame:
    """(session_id, turn, turn_id, role, at, blank): one light row per session and turn; the texts stay behind."""
    sid = F.regexp_replace("session_id", rf"^{SPACE}+|{SPACE}+$", "")
    light = turns.where(F.col("session_id").isNotNull()).select(
        sid.alias("session_id"), "turn", F.struct("turn_id", role_of(F.col("role")).alias("role"), instant_of(F.col("at")).alias("at"), is_blank(F.col("text")).alias("blank")).alias("_m")
    )
    return light.groupBy("session_id", "turn").agg(F.min("_m").alias("_m")).select("session_id", "turn", "_m.*")


def _block(turn: Column) -> Column:
    return F.floor((turn - 1) / BLOCK).cast("int")


def _cuts() -> Column:
    return F.array_sort(F.array_distinct(F.percentile_approx("at", [i / CUTS for i in range(1, CUTS)], CUTS * 10))).alias("cuts")


def _bucketed(m: DataFrame) -> DataFrame:
    """``bucket`` and ``part`` by ``at`` and ``cuts``: in the order of instants; what lies on a cut is a bucket of its own, split by ``block``."""
    below = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("at"))), F.lit(0))
    shared = F.coalesce(F.array_contains("cuts", F.col("at")), F.lit(False))
    m = m.withColumn("bucket", F.when(F.col("cuts").isNull() | F.col("at").isNull(), F.lit(0)).otherwise(2 * below + shared.cast("int") + 1))
    return m.withColumn("part", F.when(shared | F.col("at").isNull(), F.col("block")).otherwise(F.lit(0)))


def kept_messages(turns: DataFrame, inbox_meta: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """(session_id, pos, turn_id, role, at): every message of every kept conversation in order."""
    msg = stored(_messages(turns))  # read twice: once for the numbering, once for the order
    meta = inbox_meta.select(F.regexp_replace("session_id", rf"^{SPACE}+|{SPACE}+$", "").alias("session_id")).distinct()
    sound = (
        msg.groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count("turn").alias("nt"), F.count("role").alias("nr"), F.min("turn").alias("lo"), F.max("turn").alias("hi"))
        .where("n = nt and n = nr and lo = 1 and hi = n")
        .join(meta, "session_id", "left_semi")
        .select("session_id", "n")
    )
    blocks = sound.select("session_id", "n", F.explode(F.sequence(F.lit(0), _block(F.col("n")))).alias("block"))
    m = msg.withColumn("block", _block(F.col("turn"))).join(blocks, ["session_id", "block"])

    # the instant of the next lower turn, within the block and then over blocks
    by_turn = Window.partitionBy("session_id", "block").orderBy("turn")
    m = m.withColumn("at", F.last("at", ignorenulls=True).over(by_turn))
    ends = m.groupBy("session_id", "block").agg(F.max_by("at", F.when(F.col("at").isNotNull(), F.col("turn"))).alias("end"))
    before = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).drop("end")
    m = m.join(ends, ["session_id", "block"]).withColumn("at", F.coalesce("at", "carried"))

    # buckets in the order of instants; only sessions beyond one block have more than one
    long_ = m.where(F.col("n") > BLOCK)
    cuts = long_.groupBy("session_id", "n").agg(_cuts())
    cuts = cuts.select("session_id", "cuts", F.explode(F.sequence(F.lit(0), _block(F.col("n")))).alias("block"))
    m = _bucketed(m.join(cuts, ["session_id", "block"], "left")).where(~F.col("blank"))

    place = ["session_id", "bucket", "part"]
    order = Window.partitionBy(*place).orderBy(F.col("at").asc_nulls_first(), "turn")
    talk = F.col("role").isin("user", "assistant")
    said = F.when(talk, F.struct("role", "at"))
    m = m.select(*place, "turn_id", "role", "at", said.alias("said"), F.row_number().over(order).alias("rn"), F.last(said, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"))

    def unanswered(a: str, b: str) -> Column:
        far = F.col(f"{b}.at") - F.col(f"{a}.at") > gap_s * 1_000_000
        return F.coalesce((F.col(f"{a}.role") == "user") & (F.col(f"{b}.role") == "user") & far, F.lit(False))

    part = m.groupBy(*place).agg(
        F.count(F.lit(1)).alias("n"), F.max(unanswered("prev", "said")).alias("bad"), F.min_by("said", F.when(talk, F.col("rn"))).alias("first"), F.max_by("said", F.when(talk, F.col("rn"))).alias("last")
    )
    seq = Window.partitionBy("session_id").orderBy("bucket", "part")
    earlier, whole = seq.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("session_id")
    part = part.select(*place, "bad", "first", "last", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.last("last", ignorenulls=True).over(earlier).alias("came"))
    bad = F.max(F.col("bad") | unanswered("came", "first")).over(whole)
    opens, closes = F.first("first", ignorenulls=True).over(seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("last", ignorenulls=True).over(seq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    good = part.select(*place, "offset", (~bad & (opens["role"] == "user") & (closes["role"] == "assistant")).alias("ok")).where("ok").drop("ok")
    return m.join(good, place).select("session_id", (F.col("offset") + F.col("rn")).cast("long").alias("pos"), "turn_id", "role", "at")


def conversations(turns: DataFrame, inbox_meta: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """(session_id, pos, turn_id, role, at, text): the kept messages with their texts, memory-context blocks taken out."""
    kept = kept_messages(turns, inbox_meta, gap_s)
    clean = F.trim(F.regexp_replace("text", MEMO, "")).alias("text")
    return kept.join(turns.select("turn_id", clean), "turn_id").select("session_id", "pos", "turn_id", "role", F.timestamp_micros("at").alias("at"), "text")


def calibrated_gap(turns: DataFrame, share: float = 0.995) -> DataFrame:
    """(role, gap_s, n): the quantile of the silence before a message, by role; what GAP_S is to be held against.

    Messages of a session in the order of instants, then turn; blank ones and those without a readable instant or a known
    role are left out. Every message but the first of its session has a gap, across the borders of buckets too.
    """
    m = stored(_messages(turns).where("role is not null and not blank and at is not null"))
    m = m.withColumn("block", F.pmod(F.xxhash64("turn_id"), F.lit(GAP_PARTS)).cast("int"))
    size = m.groupBy("session_id", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    every = F.explode(F.sequence(F.lit(0), F.lit(GAP_PARTS - 1))).alias("block")
    long_ = m.join(size.select("session_id", every), ["session_id", "block"])
    cuts = long_.groupBy("session_id").agg(_cuts()).select("session_id", "cuts", every)
    m = _bucketed(m.join(cuts, ["session_id", "block"], "left"))
    place = ["session_id", "bucket", "part"]
    order = Window.partitionBy(*place).orderBy("at", "turn")
    m = m.select(*place, "role", "at", F.lag("at").over(order).alias("came"), F.row_number().over(order).alias("rn"))
    within = m.where("came is not null").select("role", (F.col("at") - F.col("came")).alias("us"))
    # the first message of a bucket follows the last one of the bucket before
    ends = m.groupBy(*place).agg(F.max("at").alias("end"), F.min_by("role", "rn").alias("role"), F.min("at").alias("at"))
    before = F.lag("end").over(Window.partitionBy("session_id").orderBy("bucket", "part"))
    over = ends.select("role", (F.col("at") - before).alias("us")).where("us is not null")
    gaps = within.unionByName(over).select("role", (F.col("us") / 1e6).alias("gap"))
    return gaps.groupBy("role").agg(F.percentile_approx("gap", share, 10_000).alias("gap_s"), F.count(F.lit(1)).alias("n"))
