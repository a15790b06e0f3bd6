"""Halves of the last digit round alike, in whatever order a sum ran."""

from voxtab.operators.picks import rare_blend


def test_blended_halves_round_up(spark):
    rows = [(0, 0, 0.2), (0, 1, 0.1), (0, 2, 0.3), (0, 3, 0.4)]
    mixed = rare_blend(*[spark.createDataFrame(rows, f"vec_id long, cls int, {c} double") for c in "pq"], spark.createDataFrame([(1,), (2,)], "cls int"), 0.4)
    # 0.6 * 0.3 + 0.4 * 0.4 * 0.3 / 0.4 is 0.3 but for the last bits
    assert {r["cls"]: r["p"] for r in mixed.collect()} == {0: 0.2, 1: 0.1, 2: 0.3, 3: 0.4}


def test_blend_of_the_tables(spark):
    from __spark_entry__ import queries

    found = {(r["vec_id"], r["cls"]): r["p"] for r in queries()["rare_blend"](spark, "/root/testdata/sf0.01").where("vec_id in (90, 381)").collect()}
    assert (found[90, 4], found[90, 7], found[381, 4]) == (0.039063, 0.045313, 0.132813)


def test_small_negative_numbers_keep_their_sign_as_in_sql(spark, tmp_path):
    from __spark_entry__ import queries
    from tests.oracle import duckdb
    from voxtab.plans.catalog import ORACLE_SQL

    rows = [(n, 1, [-0.0000003, 0.0000003, -0.0, -0.25, 0.5] + [1.0 / (n + 3)] * 59) for n in range(2)] + [(n, 2, [0.5] * 64) for n in range(2, 30)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = [r["x"] for r in queries()["minority_interpolation"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = [r[2] for r in con.execute(ORACLE_SQL["minority_interpolation"]).fetchall()]
    assert repr(found) == repr(want) and repr(found[0][:2]) == "[-0.0, 0.0]"
