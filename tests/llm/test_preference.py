import duckdb
import pytest
from pyspark.sql import functions as F

from binweave.llm import preference as p
from binweave.llm.queries import op4_preference_pairs

SF = "/root/testdata/sf0.01"


def by_hand(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def rest(side):
        text, spans = "", []
        for role, said in side[n:]:
            start = len(text) + len(role) + 5
            text += f"<|{role}|>\n{said}<|end|>\n"
            if role == "assistant":
                spans.append((start, len(text)))
        return text, spans

    prompt = "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in a[:n])
    return n, prompt, *rest(a), *rest(b)


CASES = [
    ([("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")]),
    ([("user", "hi"), ("assistant", "yes")], [("user", "hi")]),
    ([("user", "a")], [("user", "b"), ("assistant", "c")]),
    ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")]),
    ([], [("assistant", "é😀")]),
    ([], []),
    ([("user", "x"), ("assistant", "1"), ("user", "y"), ("assistant", "é" * 3000), ("tool", "")], [("user", "x"), ("assistant", "1"), ("user", "z")]),
]


def sides(spark, cases):
    schema = "conv_id long, turn long, role string, text string, key string, i int"
    return [p.numbered(spark.createDataFrame([(c, k, *t, "own", 0) for c, pair in enumerate(cases) for k, t in enumerate(pair[s])], schema)) for s in (0, 1)]


def test_pairs_by_hand(spark):
    out = {r["id"]: r for r in p.format_pairs(*sides(spark, CASES), "id").collect()}
    for i, (a, b) in enumerate(CASES):
        if not a and not b:
            assert i not in out
            continue
        r = out[i]
        got = (r["n_common"], r["prompt"], r["chosen"], [tuple(x) for x in r["chosen_mask"]], r["rejected"], [tuple(x) for x in r["rejected_mask"]])
        assert got == by_hand(a, b)


def test_nulls(spark):
    _, rejected = sides(spark, [([], [("user", None), (None, "x")])])
    r = p.format_pairs(rejected.limit(0), rejected).first()
    assert (r["n_common"], r["prompt"], r["chosen"]) == (0, "", "")
    assert r["rejected"] == "<|user|>\n<|end|>\n<||>\nx<|end|>\n"
    assert p.format_pairs(rejected.limit(0), rejected.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", "c"), (None, 0, None, "x"), (2, None, "user", "q")]
    df = p.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1)))
    got = sorted((r["key"] or 0, r["i"], r["role"], r["text"]) for r in df.collect())
    assert got == [(0, 1, "", "x"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", ""), (1, 4, "assistant", "c"), (2, 1, "user", "q")]
    stale = sorted((r["key"] or 0, r["i"], r["text"]) for r in p.stale_answer(df).collect())
    assert [t for *_, t in stale] == ["x", "a", "b", "", "b", "q"]


def test_query_equals_sql_and_has_no_python(spark):
    out = op4_preference_pairs(spark, SF)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(p.ORACLE_SQL).df()
    got = out.toPandas()
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].itertuples(index=False)))
    assert key(got) == key(want)


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "a" * 100_000)], [(None, None, None, None)]])
def test_sql_edges(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chosen = p.numbered(df)
    out = p.format_pairs(chosen, p.stale_answer(chosen), "conv_id").select("conv_id", "n_common", "prompt", "chosen", "rejected")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    for r in rows:
        con.execute("INSERT INTO conversations VALUES (?, ?, ?, ?)", list(r))
    want = con.execute(f"SELECT conv_id, n_common, prompt, chosen, rejected FROM ({p.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
