import random

import pytest
from pyspark.sql import functions as F

from declarium import (
    GramTable,
    fetch_candidates,
    rank_candidates,
    search,
    search_batch,
    search_exact_batch,
    search_interactive,
)
from declarium.functions.query import parse_queries
from declarium.operators import batch
from declarium.operators.top import top_per_group
from tests import model

SCHEMA = (
    "path string, name string, return_type string, params array<struct<type:string,name:string>>, "
    "signature_norm string, line int, column int"
)
WORDS = ["get", "Set", "size_t", "sizext", "red", "Widget", "ä", "main", "x"]
SIGNATURES = ["int ( int )", "int ( int , int )", "void ( const char * , size_t )", "SIZE_T ( )", "struct P * ( )"]


def make(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all rows are copies of one function.
        hot = i % 3 == 0
        name = "main" if hot else "_".join(rng.choices(WORDS, k=rng.randint(1, 3)))
        signature = "int ( int )" if hot else rng.choice(SIGNATURES)
        rows.append({"path": f"{rng.choice('abAB')}/{i}.c", "name": name, "return_type": "int", "params": [],
                     "signature_norm": signature, "line": rng.randint(1, 9), "column": 1})
    return rows


QUERIES = [
    "main ::", "size_t ::", "zzz ::", "int (int)", "get :: int (int, int)", "  ", "r%t ::", "_ ::", "% ::", "ä :: void (", "x ::",
    "main ::", "main::", "Widget :: size_t (", "red_widget :: struct P * ()", "q :: float (float)", "a\\b :: int (int)", "e_ ::", "",
]


@pytest.fixture(scope="module")
def rows():
    return make(7, 240)


@pytest.fixture(scope="module")
def functions(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query_text string").persist()


@pytest.fixture(scope="module")
def parts(queries):
    return {r["query_id"]: (r["name"], r["signature_norm"]) for r in parse_queries(queries).collect()}


def keys(hits):
    return [(h["path"], h["name"], h["line"]) for h in hits]


def by_query(df):
    found = {}
    for row in df.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append(row)
    return found


@pytest.mark.parametrize("text", ["main ::", "zzz ::", "get :: int (int, int)", "  ", "r%t ::", "size_t ::"])
def test_single_search(functions, rows, text, spark):
    query = parse_queries(spark.createDataFrame([(0, text)], "query_id long, query_text string")).first()
    want = model.search(rows, query["name"], query["signature_norm"], 6, 20)
    assert keys(search(functions, text, top=6, candidate_limit=20).collect()) == keys(want)
    want = model.search(rows, query["name"], query["signature_norm"], 6, -1)
    assert keys(search(functions, text, top=6, candidate_limit=-1).collect()) == keys(want)
    want = model.rank(rows, query["name"], query["signature_norm"], 6)
    assert keys(search(functions, text, top=6, exhaustive=True).collect()) == keys(want)


def test_defaults(functions, rows):
    assert keys(search(functions, "main ::").collect()) == keys(model.search(rows, "main", None, 20, 400))
    assert keys(search_interactive(functions, " main :: ").collect()) == keys(model.search(rows, "main", None, 50, 300))
    assert search_interactive(functions, " \t ").collect() == []
    assert fetch_candidates(functions, "").count() == 240
    assert search(functions, "main ::", top=0).collect() == search(functions, "main ::", top=-3).collect() == []


def test_stable_top(spark):
    pair = [("a.c", "subtract", "int", [], "int ( int , int )", 20, 1), ("a.c", "add", "int", [], "int ( int , int )", 10, 1)]
    candidates = spark.createDataFrame(pair, SCHEMA)
    text = "add :: int (int, int)"
    first, again = (rank_candidates(fetch_candidates(candidates, text, 50), text, 1).collect() for _ in range(2))
    assert [h["name"] for h in first] == ["add"] and first == again
    assert first[0]["score"] == 0


def test_cut_comes_before_the_score(spark):
    rows = [(f"{i}.c", f"a{i:02}_zed", "int", [], "int ( )", 1, 1) for i in range(30)] + [("z.c", "zed", "int", [], "int ( )", 1, 1)]
    functions = spark.createDataFrame(rows, SCHEMA)
    assert "zed" not in [h["name"] for h in search(functions, "zed ::", top=5, candidate_limit=30).collect()]
    assert search(functions, "zed ::", top=5, candidate_limit=31).first()["name"] == "zed"


def test_null_text():
    with pytest.raises(ValueError):
        search(None, None)


@pytest.mark.parametrize("bound", [200_000, -1])
def test_batch_equals_single_search(functions, rows, queries, parts, monkeypatch, bound):
    """Also with everything shuffled and salted."""
    monkeypatch.setattr(batch, "BROADCAST_ROWS", bound)
    found = by_query(search_batch(functions, queries, top=6, candidate_limit=20))
    for number, (name, signature) in parts.items():
        want = model.search(rows, name, signature, 6, 20)
        assert keys(found.get(number, [])) == keys(want), QUERIES[number]
        assert [h["score"] for h in found[number]] == [model.score(f, name, signature) for f in want]


def test_batch_unlimited(functions, rows, queries, parts):
    found = by_query(search_batch(functions, queries, top=6, candidate_limit=-1))
    for number, (name, signature) in parts.items():
        assert keys(found.get(number, [])) == keys(model.search(rows, name, signature, 6, -1)), QUERIES[number]


@pytest.mark.parametrize("bound", [200_000, -1])
@pytest.mark.parametrize("limit", [20, -1])
def test_stored_grams(functions, rows, queries, parts, monkeypatch, tmp_path, bound, limit):
    monkeypatch.setattr(batch, "BROADCAST_ROWS", bound)
    table = GramTable.of(functions, str(tmp_path / "grams"))
    found = by_query(search_batch(table, queries, top=6, candidate_limit=limit))
    for number, (name, signature) in parts.items():
        assert keys(found.get(number, [])) == keys(model.search(rows, name, signature, 6, limit)), QUERIES[number]


def test_search_with_stored_grams_derives_none(functions, queries, monkeypatch, tmp_path):
    table, plans, real = GramTable.of(functions, str(tmp_path / "grams")), [], batch.written
    monkeypatch.setattr(batch, "written", lambda df: (plans.append(plan(df)), real(df))[1])
    plans.append(plan(search_batch(table, queries, top=5)))
    # The stored grams are read once, by key and without any text; texts are read, never cut into grams.
    joins = [p for p in plans if "ReadSchema: struct<side:string,gram:string,text_id:bigint>" in p]
    assert len(joins) == 1 and "In(gram, [" in joins[0]
    texts = [p for p in plans if "signature_norm:string" in p or "text_id:bigint,text:string" in p]
    assert texts and not any("regexp_extract_all" in p for p in texts)


@pytest.mark.parametrize("bound", [200_000, -1])
def test_exact_batch(functions, rows, queries, parts, monkeypatch, bound):
    monkeypatch.setattr(batch, "BROADCAST_ROWS", bound)
    found = by_query(search_exact_batch(functions, queries, top=7))
    for number, (name, signature) in parts.items():
        assert keys(found.get(number, [])) == keys(model.rank(rows, name, signature, 7)), QUERIES[number]


def test_exact_batch_by_grams(functions, rows, queries, parts, monkeypatch):
    # As if there were too many texts to take all distances that lengths allow.
    monkeypatch.setattr(batch, "DENSE", 0)
    monkeypatch.setattr(batch, "RADII", [1, 2, 3])
    found = by_query(search_exact_batch(functions, queries, top=7))
    for number, (name, signature) in parts.items():
        assert keys(found.get(number, [])) == keys(model.rank(rows, name, signature, 7)), QUERIES[number]


def test_exact_batch_within(functions, rows, queries, parts):
    found = by_query(search_exact_batch(functions, queries, top=7, max_distance=5))
    for number, (name, signature) in parts.items():
        near = [f for f in rows if model.score(f, name, signature) <= 5]
        assert keys(found.get(number, [])) == keys(model.rank(near, name, signature, 7)), QUERIES[number]


def test_lengths_and_letters_leave_every_near_text(spark):
    draw = random.Random(7)
    drawn = sorted({"".join(draw.choices("ab1_\u00e9(", k=draw.randint(0, 9))) for _ in range(90)})
    texts, parts = spark.createDataFrame([(t,) for t in drawn], "text string"), spark.createDataFrame([(t, len(t) % 4) for t in drawn[::3]], "part string, radius int")
    pairs = batch._near_by_length(texts, 9, parts, batch.Extent(len(drawn), 30, 300))
    got = {(r.text, r.part) for r in pairs.collect()}
    near = texts.join(parts).where("levenshtein(text, part) <= radius")
    assert got >= {(r.text, r.part) for r in near.collect()}
    # Texts of one length with too many other letters are no pair.
    odd = spark.createDataFrame([("bcde1",), ("aaaa1",)], "text string"), spark.createDataFrame([("aaaa1", 2)], "part string, radius int")
    assert [r.text for r in batch._near_by_length(odd[0], 5, odd[1], batch.Extent(2, 1, 5)).collect()] == ["aaaa1"]


def test_names_are_measured_only_where_signatures_leave_room(spark, monkeypatch):
    rows = [(f"{k}.c", f"get_{k}", "int", [], "void ( const char * , size_t )", 1, 1) for k in range(60)]
    rows += [(f"x{k}.c", f"other_{k}", "int", [], "int ( int )", 1, 1) for k in range(30)]
    asked, measured, real = spark.createDataFrame([(1, "get_7 :: int (int)")], "query_id long, query_text string"), [], batch._measured
    monkeypatch.setattr(batch, "_measured", lambda pairs, *keep: (measured.append(pairs), real(pairs, *keep))[1])
    hits = search_exact_batch(spark.createDataFrame(rows, SCHEMA), asked, top=3).collect()
    assert [h["name"] for h in sorted(hits, key=lambda h: h["rank"])][0] == "other_7"
    assert not any("get_" in r.text for r in measured[-1].collect())


def test_exact_batch_by_shares_of_shares(functions, rows, queries, parts, monkeypatch):
    monkeypatch.setattr(batch, "SAMPLED", 2)
    monkeypatch.setattr(batch, "LEAST_PAIRS", 100)
    found = by_query(search_exact_batch(functions, queries, top=7))
    for number, (name, signature) in parts.items():
        assert keys(found.get(number, [])) == keys(model.rank(rows, name, signature, 7)), QUERIES[number]


def test_exact_batch_by_one_radius(functions, rows, queries, parts, monkeypatch):
    monkeypatch.setattr(batch, "DENSE", 0)
    assert batch.RADII == [3]
    found = by_query(search_exact_batch(functions, queries, top=7))
    for number, (name, signature) in parts.items():
        assert keys(found.get(number, [])) == keys(model.rank(rows, name, signature, 7)), QUERIES[number]


def test_exact_batch_seeks_no_common_grams(spark, monkeypatch):
    # All names share their grams: the small radius, which looks for them, is left out.
    monkeypatch.setattr(batch, "DENSE", 0)
    monkeypatch.setattr(batch, "FEW_SHARING", 0, raising=False)
    sought, real = [], batch._near_by_grams
    monkeypatch.setattr(batch, "_near_by_grams", lambda *args: (sought.append(args), real(*args))[1])
    rows = [(f"{k}.c", f"get_{k}", "int", [], "int ( int )", 1, 1) for k in range(100, 300)]
    asked = spark.createDataFrame([(1, "get150_x :: "), (2, "get_2777 :: ")], "query_id long, query_text string")
    found = by_query(search_exact_batch(spark.createDataFrame(rows, SCHEMA), asked, top=3))
    assert {n: [h["name"] for h in sorted(hits, key=lambda h: h["rank"])][0] for n, hits in found.items()} == {1: "get_150", 2: "get_277"}
    assert not sought


@pytest.mark.parametrize("few", [0, 256])
def test_few_query_parts_take_no_grams(functions, rows, queries, parts, monkeypatch, few):
    monkeypatch.setattr(batch, "FEW_PROBES", few)
    cut, real = [], batch._function_grams
    monkeypatch.setattr(batch, "_function_grams", lambda *a: (cut.append(a), real(*a))[1])
    found = by_query(search_batch(functions, queries, top=6))
    assert bool(cut) == (few == 0)
    for number, (name, signature) in parts.items():
        assert keys(found.get(number, [])) == keys(model.search(rows, name, signature, 6, 200)), QUERIES[number]


def test_few_functions_and_odd_queries(spark, functions):
    few = functions.limit(3)
    asked = spark.createDataFrame([(1, "main ::"), (2, None), (3, " "), (1_000, "none ::")], "query_id long, query_text string")
    assert set(by_query(search_batch(few, asked, top=5))) == {1, 3, 1_000}
    assert set(by_query(search_batch(few, asked, top=5, blank_is_empty=True))) == {1, 1_000}
    assert {q: len(h) for q, h in by_query(search_exact_batch(few, asked, top=5)).items()} == {1: 3, 3: 3, 1_000: 3}
    assert search_batch(functions.limit(0), asked).collect() == []
    assert search_batch(few, asked.where("query_id > 5000")).collect() == []
    assert search_batch(few, asked, top=0).collect() == []


def test_many_copies_of_one_query(spark, functions, rows):
    asked = spark.range(400).select(F.col("id").alias("query_id"), F.lit("Widget ::").alias("query_text"))
    found = by_query(search_batch(functions, asked, top=2))
    want = keys(model.search(rows, "Widget", None, 2, 200))
    assert len(found) == 400 and all(keys(hits) == want for hits in found.values())


@pytest.mark.parametrize("n", [2, 40])
def test_top_per_group_with_one_hot_group(spark, n):
    df = spark.range(0, 3000, 1, 7).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    got = top_per_group(df, ["k"], [F.col("id").desc()], n, rank="r").collect()
    want = {}
    for i in range(2999, -1, -1):
        group = want.setdefault(0 if i % 3 == 0 else i % 50, [])
        if len(group) < n:
            group.append(i)
    assert sorted((r["k"], r["r"], r["id"]) for r in got) == sorted((k, p, i) for k, ids in want.items() for p, i in enumerate(ids, 1))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(functions, queries):
    single = plan(search(functions, "main :: int (int)", top=5))
    assert single.count("TakeOrderedAndProject") == 2 and "Python" not in single
    many = plan(search_batch(functions, queries, top=5))
    assert "WindowGroupLimit" in many and "Python" not in many
    assert "CartesianProduct" not in many and "NestedLoop" not in many
    exact = plan(search_exact_batch(functions, queries, top=5))
    assert "CartesianProduct" not in exact and "NestedLoop" not in exact and "Python" not in exact
