"""Quality gates on small fixtures: hits and first places in two languages, isolation of brains, and an empty index that must fail."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.keyword import expanded, keyword_scores, merged_groups
from corpusloom.operators.pages import readable
from corpusloom.operators.statistics import hit_rates

ZH = [
    ("支付超时重试策略", "支付网关超时后最多重试三次，间隔指数退避。", "支付超时怎么重试"), ("数据库连接池配置", "连接池上限设为五十，空闲连接十分钟回收。", "连接池上限"), ("缓存雪崩复盘", "缓存同时过期造成雪崩，过期时间要加随机抖动。", "缓存雪崩"),
    ("灰度发布流程", "先放百分之五的流量，观察一小时再放开。", "灰度发布"), ("日志采集延迟", "采集端磁盘写满导致日志延迟两小时。", "日志延迟"), ("搜索排序调整", "标题命中的权重从二提高到三。", "标题命中的权重"), ("权限模型设计", "角色与资源分开存放，鉴权只看交集。", "权限模型"),
    ("消息队列积压", "消费者扩容到八个后积压清空。", "队列积压"), ("备份恢复演练", "每季度演练一次，从备份恢复要在四小时内完成。", "备份恢复"), ("接口限流方案", "令牌桶按用户限流，突发上限一百。", "令牌桶限流"), ("前端白屏排查", "静态资源证书过期引起白屏。", "白屏"), ("定时任务漏跑", "夏令时切换让定时任务漏跑一次。", "定时任务漏跑"),
]
EN = [
    ("Cache expiry", "Entries expire after ten minutes with jitter.", "cache expiry"), ("Retry policy", "Payments are retried three times with backoff.", "payments retried"), ("Pool size", "The connection pool holds fifty connections.", "connection pool"),
    ("Canary release", "Five percent of traffic goes first.", "canary"), ("Log delay", "A full disk delayed logs by two hours.", "full disk"), ("Ranking weights", "Title hits weigh three.", "title hits"), ("Access model", "Roles and resources are stored apart.", "roles and resources"),
    ("Queue backlog", "Eight consumers cleared the backlog.", "backlog"), ("Restore drill", "A restore from backup takes four hours.", "restore drill"), ("Rate limits", "A token bucket limits each user.", "token bucket"), ("White screen", "An expired certificate broke static files.", "expired certificate"), ("Missed job", "Daylight saving made a job miss its run.", "daylight saving"),
]


def index(spark, notes, brain):
    rows = [(f"brains/{brain}/n{i:02}.md", brain, "s", "note", t, "active", None, "{}", b, datetime(2026, 1, 1)) for i, (t, b, _) in enumerate(notes)]
    secret = (f"brains/other/{brain}.md", "other", "s", "note", "secret of " + notes[0][0], "active", None, "{}", " ".join(q for *_, q in notes), datetime(2026, 1, 1))
    return spark.createDataFrame([*rows, secret], "path string, brain_id string, source_id string, schema_type string, title string, status string, aliases array<string>, frontmatter_json string, body_text string, updated_at timestamp")


def measured(spark, notes, brain, pages, k):
    ranked = None
    for i, (_, _, q) in enumerate(notes):
        groups = None
        for g, form in enumerate(expanded(q)):
            hits = keyword_scores(readable(pages, brain_id=brain), form).select(F.lit(g).alias("group"), "path", "score")
            groups = hits if groups is None else groups.unionByName(hits)
        best = merged_groups(groups).orderBy(F.desc("rrf"), "path").limit(k).collect()
        some = [(i, r["path"], n + 1) for n, r in enumerate(best)]
        ranked = some if ranked is None else ranked + some
    assert not any("other" in p for _, p, _ in ranked), "a page of another brain came out"
    hits = spark.createDataFrame(ranked, "query_id int, path string, rank int")
    wanted = spark.createDataFrame([(i, f"n{i:02}.md") for i in range(len(notes))], "query_id int, part string")
    return hit_rates(hits, wanted).first()


@pytest.mark.parametrize(("notes", "k", "hit", "top"), [(EN, 10, 0.8, 0.8), (ZH, 5, 10 / 12, 0.8)])
def test_gates(spark, notes, k, hit, top):
    got = measured(spark, notes, "b", index(spark, notes, "b").cache(), k)
    assert got["n"] == 12 and got["hit_rate"] >= hit and got["top1_rate"] >= top


def test_empty_index_fails_the_gate(spark):
    assert measured(spark, EN[:3], "b", index(spark, EN, "b").limit(0), 10)["hit_rate"] == 0.0
