"""Chat sessions: buffers, windows that fill up, truncation, and the gate that decides whether a message asks the memory."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: A window closes at so many counted turns or characters.
MAX_TURNS, MAX_CHARS = 20, 16_000
TOOL_CHARS = 2000
DUPLICATE_S = 120


def counted(role: Column) -> Column:
    return F.lower(F.trim(role)).isin("user", "assistant")


def buffers(turns: DataFrame) -> DataFrame:
    """(session_id, turns, chars): counted turns of every session and their characters."""
    c = counted(F.col("role"))
    return turns.groupBy("session_id").agg(F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias("turns"), F.coalesce(F.sum(F.when(c, F.length("text"))), F.lit(0)).alias("chars"))


def windows(turns: DataFrame, max_turns: int = MAX_TURNS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(session_id, window, first_turn, last_turn, turns, chars, closed): tumbling windows in the order of arrival.

    A window closes with the turn that brings it to ``max_turns`` counted turns or ``max_chars`` characters. The sum
    starts anew where a window closes, so a session is folded turn by turn. Rows are four numbers, sorted by Spark (which
    spills), and the fold keeps one open window: no session is ever held in memory. Null turns come first.
    """
    c = counted(F.col("role"))
    light = turns.where("session_id is not null").select("session_id", "turn", F.coalesce(c.cast("int"), F.lit(0)).alias("k"), F.coalesce(F.when(c, F.length("text")), F.lit(0)).alias("c"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["session_id", "window", "first_turn", "last_turn", "turns", "chars", "closed"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        now, index, first, last, n, size, any_ = None, 0, None, None, 0, 0, False

        for b in batches:
            out: list[tuple] = []
            for sid, turn, k, chars in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if sid != now:
                    if any_:
                        out.append((now, index, first, last, n, size, False))
                    now, index, n, size, any_ = sid, 0, 0, 0, False
                if not any_:
                    first, any_ = turn, True
                last, n, size = turn, n + k, size + chars
                if n >= max_turns or size >= max_chars:
                    out.append((now, index, first, last, n, size, True))
                    index, n, size, any_ = index + 1, 0, 0, False
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, index, first, last, n, size, False), types, strict=True)], names=names)

    ordered = light.repartition("session_id").sortWithinPartitions("session_id", "turn", "k", "c")
    return ordered.mapInArrow(fold, "session_id string, window int, first_turn int, last_turn int, turns int, chars long, closed boolean")


def truncated(turns: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Turns that stay when the oldest counted ones go until their characters fit; the last one always stays."""
    c = counted(F.col("role"))
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    so_far = F.sum(F.when(c, F.length("text")).otherwise(0)).over(w)
    nth = F.sum(c.cast("int")).over(w)
    return turns.withColumn("_s", so_far).withColumn("_n", nth).where(~F.coalesce(c, F.lit(False)) | (F.col("_s") <= max_chars) | (F.col("_n") == 1)).drop("_s", "_n")


def clean_text(role: Column, text: Column) -> Column:
    """The text without memory-context blocks; that of a tool is cut to TOOL_CHARS characters."""
    t = F.regexp_replace(text, r"(?is)<[a-z]+-memory-context\b[^>]*>.*?</[a-z]+-memory-context>", "")
    return F.when(F.lower(F.trim(role)) == "tool", F.substring(t, 1, TOOL_CHARS)).otherwise(t)


def without_repeats(events: DataFrame, key: list[str], at: str = "ts", seconds: int = DUPLICATE_S) -> DataFrame:
    """Events whose key did not come within the ``seconds`` before."""
    w = Window.partitionBy(*key).orderBy(at, *[c for c in ("event_id",) if c in events.columns])
    before = F.lag(at).over(w)
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_b").cast("timestamp")) > seconds * 1_000_000)).drop("_b")


def flush_batches(events: DataFrame, key: str, at: str = "ts", most: int = 20, seconds: int = 300) -> DataFrame:
    """(key, batch, first_at, last_at, n): batches of writes that close with ``most`` writes or ``seconds`` after the last close.

    Like ``windows``, a fold over rows that Spark has sorted; it keeps one open batch.
    """
    kind = events.schema[key].dataType.simpleString()
    micros = F.unix_micros(F.col(at).cast("timestamp"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, first, last, n, closed = None, 0, 0, 0, 0, None
        fresh = True

        def out(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            types = [like.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "batch", "first_us", "last_us", "n"])

        b = None
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fresh or k != now:
                    if n:
                        rows.append((now, index, first, last, n))
                    now, index, n, closed, fresh = k, 0, 0, t, False
                first, last, n = (t if n == 0 else first), t, n + 1
                if n >= most or t - closed >= seconds * 1_000_000:
                    rows.append((now, index, first, last, n))
                    index, n, closed = index + 1, 0, t
            yield out(rows, b)
        if n:
            yield out([(now, index, first, last, n)], b)

    ordered = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, micros.alias("us")).repartition(key).sortWithinPartitions(key, "us")
    folded = ordered.mapInArrow(fold, f"`{key}` {kind}, batch int, first_us long, last_us long, n int")
    return folded.select(key, "batch", F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("last_us").alias("last_at"), "n")


def prompts(turns: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(session_id, n, prompt): the numbered lines of a session for an extractor; truncated first, so a line list is bounded."""
    t = truncated(turns.where(counted(F.col("role"))), max_chars).select("session_id", "turn", F.lower(F.trim("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["role"], F.lit(": "), x["text"])), "\n")
    return t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), text.alias("prompt"))


def turns_in_range(source_turns: Column, n: Column) -> Column:
    """Whether all of an extractor's source turns are turns of the session."""
    return F.forall(source_turns, lambda x: (x >= 1) & (x <= n))


def pruned(rows: DataFrame, now: str, at: str = "created_at", key: str = "session_id", keep: int = 50, days: int = 7) -> DataFrame:
    """Finished rows that stay: the newest ``keep``, and those not older than ``days``. The ``keep``-th is found by a top-k."""
    done = rows.where(F.col("status").isin("done", "failed"))
    top = done.select(at, key).orderBy(F.desc(at), F.desc(key)).limit(keep).agg(F.min(F.struct(at, key)).alias("k")).select("k.*").first()
    young = F.col(at).cast("timestamp_ntz") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    if top[0] is None:
        return done.where(young)
    kind = rows.schema[at].dataType
    newest = (F.col(at) > F.lit(top[0]).cast(kind)) | ((F.col(at) == F.lit(top[0]).cast(kind)) & (F.col(key) >= F.lit(top[1])))
    return done.where(young | newest)


def latest_status(rows: DataFrame, key: str = "session_id", status: str = "status", at: str = "created_at") -> DataFrame:
    """(key, status, at): the last status of every key."""
    return rows.groupBy(key).agg(F.max(F.struct(at, status)).alias("_r")).select(key, F.col(f"_r.{status}").alias(status), F.col(f"_r.{at}").alias(at))


#: Words that make a message ask the memory or not, and what each group counts.
HISTORY = ["以前", "上次", "谁决定", "踩过", "我们约定", "last time", "how did we"]
CONVENTION = ["依赖", "目录结构", "错误码", "鉴权", "公共 api", "memory.yml", "errorcodes"]
OPERATIONAL = ["实现", "修复", "重构", "部署", "写入", "create", "implement", "fix", "deploy", "build"]
EXECUTE = ["测试", "构建", "调试", "test", "build", "debug", "run"]
FAILURE = ["报错", "失败", "异常", "timeout", "exception", "error", "e_"]
ENGINEERING = ["errorcodes", "hook", "api", "pack", "memory.yml"]
EXPERIENCE = ["踩坑", "教训", "best practice", "avoid"]
CONVERSATIONAL = ["你好", "谢谢", "好的", "ok", "继续", "再试", "修一下", "lint 一下", "翻译", "总结这段"]
KNOWLEDGE = ["什么是", "what is", "what's"]
FORCED = "查一下记忆"
GATE = [(3, HISTORY), (3, CONVENTION), (3, OPERATIONAL), (2, EXECUTE), (1, EXPERIENCE), (-3, CONVERSATIONAL)]
FAILURE_POINTS, FAILURE_LEAST = 2, 2
ENGINEERING_POINTS, KNOWLEDGE_POINTS, REPEAT_POINTS = 2, -2, -3
GATE_LEAST, GATE_CHARS = 3, 4
#: A path or a file name in a lower-case text.
PATH_LIKE = r"""(^|[\s`'"])([a-z0-9_.-]+/)+[a-z0-9_.-]+|\.[a-z]{1,8}([^a-z0-9_]|$)"""


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def gate_score(text: Column, fail_count: Column | int = 0) -> Column:
    """What the words of a message speak for asking the memory; ``fail_count``: failures before it in a row."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    fails = fail_count if isinstance(fail_count, Column) else F.lit(fail_count)
    path = t.rlike(PATH_LIKE)
    score = reduce(lambda a, b: a + b, [F.when(_has(t, words), points).otherwise(0) for points, words in GATE])
    score = score + F.when(_has(t, FAILURE) & (fails >= FAILURE_LEAST), FAILURE_POINTS).otherwise(0)
    score = score + F.when(_has(t, ENGINEERING) | path, ENGINEERING_POINTS).otherwise(0)
    busy = _has(t, OPERATIONAL) | _has(t, EXECUTE) | _has(t, ENGINEERING) | _has(t, CONVENTION) | path
    return score + F.when(_has(t, KNOWLEDGE) & ~busy, KNOWLEDGE_POINTS).otherwise(0)


def gate_command(text: Column, score: Column, fail_count: Column | int = 0, session_start: Column | bool = False) -> Column:
    """``think``, ``find`` or null: whether and how a message of this score asks the memory.

    Short messages and those that carry memory themselves don't; the start of a session always thinks; /memory and FORCED
    always find; else the score decides, and what is to be done or keeps failing thinks.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    fails = fail_count if isinstance(fail_count, Column) else F.lit(fail_count)
    start = session_start if isinstance(session_start, Column) else F.lit(session_start)
    thinks = _has(low, OPERATIONAL) | (fails >= FAILURE_LEAST)
    asked = F.when(start, "think").when(low.rlike(r"^/memory(\s|$)") | t.contains(FORCED), "find").when(score >= GATE_LEAST, F.when(thinks, "think").otherwise("find"))
    return F.when((F.length(t) >= GATE_CHARS) & ~t.contains("<df-memory-context"), asked)


def recall_gate(turns: DataFrame) -> DataFrame:
    """(turn_id, session_id, score, asks): user messages that ask the memory; one like the one before it counts 3 less."""
    u = turns.where(F.lower(F.trim("role")) == "user").select("turn_id", "session_id", "turn", "text")
    before = F.lag("text").over(Window.partitionBy("session_id").orderBy("turn", "turn_id"))
    same = F.coalesce(T.jaccard(F.array_distinct(T.words(F.col("text"))), F.array_distinct(T.words(before))) >= 0.5, F.lit(False))
    scored = u.withColumn("score", gate_score(F.col("text")) + F.when(same, REPEAT_POINTS).otherwise(0))
    return scored.select("turn_id", "session_id", "score", gate_command(F.col("text"), F.col("score")).isNotNull().alias("asks"))
