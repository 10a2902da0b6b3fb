from __future__ import annotations

from datetime import UTC, datetime

import pytest

from keyfold.plans import layers as Y
from keyfold.schema import OPLOG
from keyfold.sources import snapshots as S
from keyfold.sources.tables import append_log, read_log

VERSIONS = "key string, value string, deleted boolean, expire_time bigint, ts timestamp, seq bigint"


def at(i):
    return datetime.fromtimestamp(86400 * i, UTC)


def test_life_of_snapshots(spark, tmp_path):
    folder = str(tmp_path / "snap")
    log = spark.createDataFrame([(f"k{i % 4}", f"v{i}", i % 5 == 0, 0, at(i), i) for i in range(1, 30)], VERSIONS)
    assert S.restore(spark, folder) is None and S.versions(spark, folder).count() == 0
    for seq in (10, 20):
        S.export(Y.snapshot(log, seq), folder, seq)
    with pytest.raises(ValueError):
        S.export(Y.snapshot(log, 20), folder, 20)
    assert [(r.seq, r.entries, r.min_key, r.max_key) for r in S.versions(spark, folder).orderBy("seq").collect()] == [(10, 4, "k0", "k3"), (20, 4, "k0", "k3")]
    whole = sorted(map(tuple, Y.merge(log).select("key", "value", "seq").collect()))
    for up_to, want in ((None, 20), (19, 10)):
        state, seq = S.restore(spark, folder, up_to)
        assert seq == want and sorted(map(tuple, Y.snapshot_and_tail(state, log, seq).select("key", "value", "seq").collect())) == whole
    assert S.restore(spark, folder, 9) is None
    S.delete(spark, folder, 20)
    assert S.restore(spark, folder)[1] == 10
    S.clear(spark, folder)
    assert S.restore(spark, folder) is None
    S.export(Y.snapshot(log, 0), folder, 0)  # an empty state
    assert S.restore(spark, folder)[0].count() == 0


def test_log_is_cut_behind_a_snapshot(spark, tmp_path):
    path = str(tmp_path / "log")
    append_log(spark.createDataFrame([(i, at(i // 3), None, "set", "k", [str(i)]) for i in range(10)], OPLOG), path)
    assert S.truncate_log(spark, path, 6) == ["day=1970-01-01", "day=1970-01-02"]
    assert sorted(r.seq for r in read_log(spark, path).collect()) == [6, 7, 8, 9]
    assert [r.seq for r in read_log(spark, path, after=6).orderBy("seq").collect()] == [7, 8, 9]
    assert S.truncate_log(spark, path, 6) == []
