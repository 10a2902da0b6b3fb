from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.llm import kernels as K
from keyfold.llm import quality
from tests.llm.conftest import odd_rows


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    docs = docs.cache()
    model = quality.fit(docs, labels.where("doc_id % 4 <> 0"))
    scored = quality.evidence(docs, model)
    out = quality.classify(scored, model, quality.sites(scored, "source", "lang"))
    held = out.join(labels.where("doc_id % 4 = 0"), "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    right, clean, n, m = held.agg(F.avg((F.col("kept") == good).cast("int")), F.avg(F.when(good, F.col("kept").cast("int"))), F.count("*"), F.sum((~good).cast("int"))).first()
    assert n > 900 and m > 150 and right > 0.97 and clean > 0.98


def brute(rows):
    """rows (id, host, path, logit) -> {id: (host posterior, path posterior, score)}, in plain Python throughout."""
    p = {i: 1 / (1 + math.exp(-x)) for i, _, _, x in rows}
    host, path = {}, {}
    for i, h, q, _ in rows:
        host.setdefault(h, []).append(p[i])
        path.setdefault((h, q), []).append(p[i])
    mean = lambda x: sum(x) / len(x)
    overall = mean(list(p.values()))

    def strength(groups):
        """groups: (values, mean of the parent)."""
        some = [(len(v), mean(v), m) for v, m in groups if len(v) > 1]
        total = sum(n for n, _, _ in some)
        if not total:
            return quality.STRONGEST
        spread = sum(n * (m - up) ** 2 for n, m, up in some) / total
        noise = sum(up * (1 - up) for _, _, up in some) / total
        inner = sum(n * up * (1 - up) for n, _, up in some) / total
        return max(min(inner / max(spread - noise, 1e-9) - 1, quality.STRONGEST), quality.WEAKEST)

    m_host, m_path = strength([(v, overall) for v in host.values()]), strength([(v, mean(host[h])) for (h, _), v in path.items()])
    odds = lambda x: math.log(x / (1 - x))
    out = {}
    for i, h, q, x in rows:
        a = (sum(host[h]) - p[i] + m_host * overall) / (len(host[h]) - 1 + m_host)
        b = (sum(path[h, q]) - p[i] + m_path * a) / (len(path[h, q]) - 1 + m_path)
        out[i] = (a, b, x + quality.SITE_WEIGHT * (odds(b) - odds(overall)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_posteriors_and_scores_against_brute_force(spark, seed):
    r = random.Random(seed)
    level = {h: r.uniform(-3, 3) for h in ("h1", "h2", "h3", None)}
    rows = [(i, h, q, level[h] + r.gauss(0, 1) + (q == "p1")) for i in range(300) for h, q in [(r.choices(list(level), [9, 3, 1, 1])[0], r.choice(["p0", "p1", None]))]]
    rows += [(300, "alone", "p0", -2.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, doc_logit double")
    want = brute(rows)
    got = {x.doc_id: (x.host_posterior, x.path_posterior, x.score, x.kept) for x in quality.classify(df, None, quality.sites(df, "source", "lang")).collect()}
    assert got.keys() == want.keys()
    for i, (a, b, score) in want.items():
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got[i], (a, b, score), strict=False)) and got[i][3] == (got[i][2] >= 0)


def test_odd_documents(spark, odd, clashing, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, None), (4, 1, None), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(clashing, labels)
    scored = quality.evidence(clashing, model)
    out = quality.classify(scored, model, quality.sites(scored, "source", "lang"))
    assert out.count() == odd.count() and set(clashing.columns) <= set(out.columns)
    assert out.where("score is null or isnan(score)").count() == 0
    assert {tuple(r) for r in out.select("n_host", "_features", "_host", "s_all").distinct().collect()} == {("own n_host", "own _features", "own _host", "own s_all")}
    assert quality.classify(quality.evidence(nothing, model), model, quality.sites(quality.evidence(nothing, model), "source", "lang")).count() == 0


def test_without_labels_all_are_kept(spark, odd):
    model = quality.fit(odd, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    scored = quality.evidence(odd, model)
    out = quality.classify(scored, model, quality.sites(scored, "source", "lang"))
    assert model is None and out.where("kept").count() == odd.count()


def test_sample_is_bounded(spark):
    labels = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    assert 300 < quality.labelled(labels, 500).count() < 700
    assert quality.labelled(labels, 5000).count() == 5000


def test_fit_may_take_its_80_steps(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    assert quality.fit(docs, labels).getMaxIter() == 80


def test_features_belong_to_each_text_alone():
    """A batch's features are those of its texts one by one; case and marks don't matter to words, null is as empty."""
    texts = [t for t in (r[1] for r in odd_rows()) if t is None or len(t) < 20_000] + ["Ça va, “École”?", "ça va école", "¿Qué?", "x", "", None]
    of = lambda ts: quality.hashed_features(*K.text_buffer(pa.array(ts, pa.string())))
    doc, feature = of(texts)
    for i, t in enumerate(texts):
        assert feature[doc == i].tolist() == of([t])[1].tolist() == sorted(set(of([t])[1].tolist()))
    one, two = (set(of([t])[1].tolist()) for t in ("Ça va, “École”?", "ça va école"))
    assert len(one & two) >= 6  # three words and their beginnings
    assert len(of([""])[1]) == 5 and of([None])[1].tolist() == of([""])[1].tolist()


def test_each_loss_takes_two_stages_at_most(spark):
    """However many parts the written sample has, so that the driver's buffers for each stage stay few."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        assert quality.fit(docs, labels) is not None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    jobs = [[status.getStageInfo(s) for s in status.getJobInfo(j).stageIds] for j in status.getJobIdsForGroup("fit")]
    losses = [[s.numTasks for s in job if s] for job in jobs if any(s and "RDDLossFunction" in s.name for s in job)]
    assert len(losses) > 20 and max(map(len, losses)) == 2 and max(map(max, losses)) == quality.PARTS
