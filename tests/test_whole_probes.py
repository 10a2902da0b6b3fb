from __future__ import annotations

from keyfold import queries as Q

SF = "/root/testdata/sf0.001"


def test_every_supplier_and_every_line_is_asked(spark):
    got = Q.FOUND["sismember_every_key"][0](spark, SF).collect()
    suppliers = {f"sup:{r.s_suppkey}" for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    lines = {(f"sup:{r.l_suppkey}", str(r.l_partkey)) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()}
    assert suppliers <= {r.key for r in got}
    assert {(r.key, r.member) for r in got if r.found} == lines and any(not r.found for r in got)


def test_every_member_has_its_rank(spark):
    got = sorted(tuple(r) for r in Q.FOUND["zrank_of_every_member"][0](spark, SF).collect())
    every = sorted((r.key, r.member, r.rank) for r in Q.FOUND["zrank"][0](spark, SF).collect())
    assert got == every and len(got) == spark.read.parquet(f"{SF}/customer.parquet").count()
