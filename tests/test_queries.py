"""Every query of the engine against its SQL, on the smallest tables."""

import os

import numpy as np
import pytest

from wavemill.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("test tables are absent")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, db, name):
    a = plans.queries()[name](spark, SF).toPandas()
    b = db.execute(plans.oracle_sql()[name]).df()
    assert sorted(a) == sorted(b) and len(a) == len(b)
    a, b = a[sorted(a)].sort_values(sorted(a)).reset_index(drop=True), b[sorted(b)].sort_values(sorted(b)).reset_index(drop=True)
    for c in a:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(plans.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_index_holds_every_row(spark, sf_dir):
    from wavemill.operators import tables

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p = tables.project_clouds(e, plans._dirs(), id_col="vec_id", cloud_col="embedding")
    want = {}
    for r in tables.sw1_top_k(p, p, 5, plans.N_DIRS, id_col="vec_id").collect():
        want.setdefault(r.query, set()).add(r.neighbour)
    for got in (tables.indexed_knn(e, e, 8, id_col="vec_id", cloud_col="embedding", tau=0.5, k=5, directions=plans.N_DIRS), tables.indexed_knn(e, e, 8, id_col="vec_id", cloud_col="embedding", tau=0.5, k=5, directions=plans.N_DIRS, shard=150)):
        near = {r.vec_id: set(r.nearest) for r in got.collect()}
        assert set(near) == set(want) and all(i not in x and len(x) == 5 for i, x in near.items())
        assert sum(len(near[i] & want[i]) for i in want) >= 0.9 * 5 * len(want)
    graph = plans.anomaly_graph(spark, sf_dir).collect()
    assert sorted(r.id for r in graph) == sorted(want) and all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in graph)
    shard = {r.id: r.shard for r in graph}
    edges = plans.layer0_edges(spark, sf_dir).collect()
    assert {i for r in edges for i in (r.i, r.j)} == set(shard) and all(r.i != r.j and shard[r.i] == shard[r.j] == r.shard for r in edges)
    assert len({(r.i, r.j) for r in edges}) == len(edges)


def test_scratch_is_shared_or_refused(spark, monkeypatch):
    from wavemill.sources import scratch

    t = scratch.cut(spark.range(5))
    assert t.count() == 5
    scratch.clean(spark)
    with pytest.raises(Exception):
        t.collect()

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Conf:
        get = staticmethod(lambda k, d=None: d)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        scratch.scratch_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        scratch.scratch_dir(Session())


def test_portable_functions_round_as_sql(spark, db, tmp_path):
    """Values whose ninth digit hangs on the last place of exp or on how ties are
    rounded, and null."""
    v = [619.52, 712.91, 861.0, 932.15, 245.13, 0.0, None]
    rows = [(i, x) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, plans.queries()["portable_functions"](spark, str(tmp_path)).collect()))
    other = db.cursor()
    other.execute(f"create or replace temp view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(other.execute(plans.oracle_sql()["portable_functions"]).fetchall())
    assert got == want and got[-1] == (6, *[None] * 5)


def test_nearest_doubles():
    """Known digits, and the kernels within one last place of them."""
    from wavemill.functions import detmath as m

    assert m.nearest("sin", 1e22) == -0.8522008497671888 and m.nearest("cos", 0.0) == 1.0
    assert m.nearest("exp", 619.52 / 100) == 490.38951309349994 and m.nearest("ln", 2.0) == m.LN2
    x = np.concatenate([np.linspace(0.01, 700, 400), np.linspace(1e6, 5e9, 100)])
    for name in ("exp", "ln", "sin", "cos"):
        at = x[x <= 700] if name == "exp" else x
        n = np.array([m.nearest(name, float(t)) for t in at])
        assert (np.abs(getattr(m, name)(at) - n) <= np.spacing(np.abs(n))).all()
        if name in ("sin", "cos"):
            flip = np.array([m.nearest(name, -float(t)) for t in at])
            assert (flip == (-n if name == "sin" else n)).all()
