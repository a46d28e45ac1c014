"""Scoring, the ledger, search and layout on small fixtures, against brute force where there is no SQL."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thetaloom.operators import integrity as I
from thetaloom.operators import layout as L
from thetaloom.operators import records as D
from thetaloom.operators import cells, curves, postings
from thetaloom.operators import retrieval as R
from thetaloom.operators import testtaking as T
from thetaloom.operators import validation as V
from thetaloom.operators import work as W
from thetaloom.session import new_path
from thetaloom.sources import files
from thetaloom.sources.vectors import VectorStore


def test_score_answers(spark):
    """A sheet of three parts, an essay whose scaling has as many points as its guide, and an option item with two takers."""
    items = spark.createDataFrame(
        [("option", "multiple_choice", "D", 1), ("essay", "constructed_response", None, 2), ("sheet", "constructed_response", None, 3), ("yes", "constructed_response", None, 2)],
        "item_key string, item_type string, correct_option string, max_points int",
    )
    parameters = spark.createDataFrame([("option", "3PL", 1), ("essay", "GPCM", 2), ("sheet", "GPCM", 3), ("yes", "2PL", 1)], "item_key string, irt_model string, scaled_points int")
    given = {
        ("p", "option"): "D", ("q", "option"): None, ("r", "option"): "d",
        ("p", "essay"): "long text", ("q", "essay"): "\t ", ("r", "essay"): "nobody read this",
        ("p", "sheet"): "three lines", ("q", "sheet"): "one line",
        ("p", "yes"): "almost", ("q", "yes"): "exactly", ("p", "elsewhere"): "D",
    }
    answers = spark.createDataFrame([(*key, text) for key, text in given.items()], "condition string, item_key string, answer string")
    part = "M051234"
    graded = [("essay", "long text", None, "Partial Response"), ("yes", "almost", None, "Partial Response"), ("yes", "exactly", None, "Correct Response"), ("essay", "\t ", None, "Incorrect Response")]
    graded += [("sheet", "three lines", f"{part}{x}", f"{part}{x} Correct Response") for x in "CAB"]
    graded += [("sheet", "one line", f"{part}{x}", f"{part}{x} {'Correct' if x == 'B' else 'Incorrect'} Response") for x in "ABC"]
    verdicts = spark.createDataFrame(graded, "item_key string, response string, part string, category string")
    verdicts = verdicts.select("item_key", F.sha2("response", 256).alias("response_hash"), "part", "category", F.lit("because").alias("reasoning"))
    found = {(r["condition"], r["item_key"]): (r["points"], r["score"]) for r in T.score_answers(answers, items, parameters, verdicts).collect()}
    assert found == {
        ("p", "option"): (1, 1), ("q", "option"): (0, 0), ("r", "option"): (0, 0), ("p", "essay"): (1, 1), ("q", "essay"): (0, 0), ("r", "essay"): (None, None),
        ("p", "sheet"): (3, 3), ("q", "sheet"): (1, 1), ("p", "yes"): (1, 0), ("q", "yes"): (2, 1),
    }
    row = T.score_answers(answers, items, parameters, verdicts).filter("condition = 'p' and item_key = 'sheet'").first()
    assert row["scorer_category"] == " + ".join(f"{part}{x} Correct Response" for x in "ABC")


def test_guides(spark):
    rows = [("ok", 2, 1, "Correct Response"), ("ok", 2, 2, "Partial Response"), ("ok", 2, 3, "Incorrect Response"), ("gap", 2, 1, "Correct"), ("gap", 2, 2, "Incorrect"),
            ("odd", 1, 1, "Whatever"), *[("parts", 2, i, f"M071905{p} {c}") for i, (p, c) in enumerate([("A", "Correct"), ("A", "Incorrect"), ("B", "Correct"), ("B", "Incorrect")])],
            *[("mixed", 2, i, c) for i, c in enumerate(["M071905A Correct", "M071905A Incorrect", "Correct", "Incorrect"])]]
    guides = spark.createDataFrame(rows, "item_key string, max_points int, position int, category string")
    assert {r["item_key"] for r in I.guide_violations(guides).collect()} == {"gap", "odd", "mixed"}
    assert {r["part"] for r in I.guide_categories(guides).filter("item_key = 'parts'").collect()} == {"M071905A", "M071905B"}


def test_unknown_metadata_field(tables):
    with pytest.raises(ValueError, match="Unknown fields"):
        I.metadata_filter(tables.v_items, colour="red")


def brute_next_fit(sizes, capacity):
    fill, batch, result = None, -1, []
    for n in sizes:
        if fill is None or fill + n > capacity:
            fill, batch = n, batch + 1
        else:
            fill += n
        result.append(batch)
    return result


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_next_fit_in_parallel_stretches(spark, chunk):
    random.seed(chunk)
    data = {key: [random.randint(1, 14) for _ in range(60)] for key in ("a", "b")}
    rows = [(key, i, n) for key, sizes in data.items() for i, n in enumerate(sizes)]
    found = W.next_fit(spark.createDataFrame(rows, "k string, o bigint, n int"), "k", "o", "n", 10, chunk).collect()
    for key, sizes in data.items():
        got = [r["batch"] for r in sorted((r for r in found if r["k"] == key), key=lambda r: r["o"])]
        assert got == brute_next_fit(sizes, 10)


def test_lines_are_anchored_not_chained(spark):
    rows = [(1, y, f"w{y}", 100 - y) for y in (0.0, 3.0, 3.9, 4.0, 7.0, 8.0)] + [(2, 5.0, "x", 1.0)]
    words = spark.createDataFrame(rows, "page int, center double, word string, x double")
    found = {(r["page"], r["center"]): r["line"] for r in L.lines(words, "page", "center").collect()}
    assert [found[1, y] for y in (0.0, 3.0, 3.9, 4.0, 7.0, 8.0)] == [0, 0, 0, 1, 1, 2]
    text = {(r["page"], r["line"]): r["text"] for r in L.line_text(L.lines(words, "page", "center"), "page", "x", "word", "center").collect()}
    assert text[1, 0] == "w3.9 w3.0 w0.0"


def test_coverage(spark):
    pairs = spark.createDataFrame([(1, "The 3 cats, sat!", "thecats"), (2, "all here", "All, here.")], "k int, a string, b string")
    rows = L.coverage(pairs, "k", "a", "b").collect()
    assert [tuple(r) for r in rows] == [(1, pytest.approx(2 / 3), "sat")]


def test_search_against_brute_force(tables, spark, monkeypatch):
    # Small blocks, so that queries and candidates meet across several block pairs.
    monkeypatch.setattr(cells, "SLICE", 40)
    monkeypatch.setattr(postings, "BLOCK", 30)
    monkeypatch.setattr(postings, "QUERIES", 20)
    monkeypatch.setattr(postings, "LISTS", 2)
    bank = R.indexed(tables.v_bank.withColumnRenamed("embedding", "vector"))
    rows = bank.collect()
    queries = bank.withColumnRenamed("item_key", "query_key")
    vectors = {r["item_key"]: np.array(r["vector"], float) / np.linalg.norm(np.array(r["vector"], float)) for r in rows if r["vector"]}
    found = R.semantic_search(queries, bank, 5, ["grade"], "part_group").collect()
    got = {}
    for r in found:
        got.setdefault(r["query_key"], []).append((r["rank"], r["item_key"]))
    df = {}
    for r in rows:
        for term in set(r["tokens"]):
            df[term] = df.get(term, 0) + 1
    average = np.mean([len(r["tokens"]) for r in rows])

    def bm25(q, c):
        total = 0.0
        for term in set(q["tokens"]) & set(c["tokens"]):
            tf = c["tokens"].count(term)
            total += tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c["tokens"]) / average)) * math.log((len(rows) - df[term] + 0.5) / (df[term] + 0.5) + 1)
        return total

    keyword = {}
    for r in R.keyword_search(queries, bank, 5, ["grade"], "part_group").collect():
        keyword.setdefault(r["query_key"], []).append((r["rank"], r["item_key"]))
    for q in rows[:20]:
        allowed = [c for c in rows if c["grade"] == q["grade"] and c["part_group"] != q["part_group"]]
        if q["item_key"] in vectors:
            with_vector = [c for c in allowed if c["item_key"] in vectors]
            best = sorted(with_vector, key=lambda c: (-round(float(vectors[q["item_key"]] @ vectors[c["item_key"]]), 6), c["item_key"]))[:5]
            assert [k for _, k in sorted(got[q["item_key"]])] == [c["item_key"] for c in best]
        else:
            assert q["item_key"] not in got
        best = sorted(((-round(bm25(q, c), 6), c["item_key"]) for c in allowed))[:5]
        assert [k for _, k in sorted(keyword[q["item_key"]])] == [k for score, k in best if score < 0]


def test_references_leave_out_the_part_group(tables):
    bank = R.indexed(tables.v_bank.withColumnRenamed("embedding", "vector"))
    found = R.references(bank, n_similar=4, n_same_model=3)
    groups = bank.select("item_key", "part_group", "grade")
    target = groups.select(F.col("item_key").alias("target_key"), F.col("part_group").alias("tp"), F.col("grade").alias("tg"))
    joined = found.join(groups, "item_key").join(target, "target_key")
    assert joined.filter("part_group = tp or grade <> tg").count() == 0
    ranks = found.groupBy("target_key").agg(F.max("rank").alias("m"), F.count("*").alias("n"), F.count_distinct("item_key").alias("d"))
    assert ranks.filter("m <> n or n <> d or n < 4 or n > 7").count() == 0
    assert R.without_references(bank, found).count() == 0
    with pytest.raises(ValueError, match="method"):
        R.similar_items(bank, 3, "fuzzy")


def test_pending_cap_and_order(tables):
    requests = tables.v_requests
    none = requests.limit(0)
    first = [r[0] for r in W.pending(requests, none, none, cap=20).select("request_id").collect()]
    again = [r[0] for r in W.pending(requests.repartition(3), none, none, cap=20).select("request_id").collect()]
    assert len(first) == 20 and sorted(first) == sorted(again)


def test_crossing_of_any_number_of_conditions(spark):
    conditions = spark.range(12_000).selectExpr("id as c", "concat('s', id % 7) as setting")
    rows = D.crossed(spark.range(2).withColumnRenamed("id", "item"), conditions, ["setting", "c"])
    assert rows.count() == 24_000
    first = rows.filter("item = 0").orderBy("condition_order").limit(2).collect()
    assert [(r["c"], r["setting"], r["condition_order"]) for r in first] == [(0, "s0", 0), (7, "s0", 1)]


def test_next_fit_keeps_order_columns_of_any_type(spark):
    large = 2**53
    rows = [("k", large + i, f"u{i:02d}", 6) for i in range(4)] + [(None, 1, "a", 3), (None, 2, "b", 8)]
    df = spark.createDataFrame(rows, "k string, o bigint, name string, n int")
    for order in ("o", "name"):
        found = W.next_fit(df.filter("k is not null"), "k", order, "n", 10).collect()
        assert sorted((r["o"], r["name"], r["batch"]) for r in found) == [(large + i, f"u{i:02d}", i) for i in range(4)]


def test_three_points(spark):
    from thetaloom.operators import integrity as I

    rows = [("ok", 3, 0.5, 0.3, -0.8), ("unbalanced", 3, 0.5, 0.3, -0.7), ("short", 3, 0.5, -0.5, None), ("two", 2, 0.5, -0.5, None), ("long", 2, 0.5, -0.4, -0.1)]
    df = spark.createDataFrame([(k, "constructed_response", "GPCM", p, 1.0, 0.0, None, *s) for k, p, *s in rows], "item_key string, item_type string, irt_model string, scaled_points int, slope double, location double, guessing double, step1 double, step2 double, step3 double")
    assert {(r["item_key"], r["rule"]) for r in I.parameter_violations(df).collect()} == {
        ("unbalanced", "steps do not sum to 0"), ("short", "not exactly the parameters of the model"), ("long", "not exactly the parameters of the model"),
    }
    checks = T.model_checks(df.filter("item_key in ('ok', 'two')")).collect()
    assert all(r["passes"] for r in checks)
    grid = T.log_probability_grid(df.filter("item_key = 'ok'"), step=0.5)
    assert {r["score"] for r in grid.select("score").distinct().collect()} == {0, 1, 2, 3}


def test_log_probability_totals(spark, monkeypatch):
    """Against the rows of the grid, added up: groups of many and single items and a missing group, missing parameters, scores
    above the points of a 2PL item, more groups than a task holds. Steep curves are not below the floor."""
    monkeypatch.setattr(curves, "GROUPS", 2)
    items = [("3PL", 1, 1.2, 0.3, 0.2, None, None, None), ("2PL", 2, 0.7, -1.0, None, None, None, None), ("GPCM", 2, 1.0, 0.5, None, 0.4, -0.4, None), ("GPCM", 3, 0.9, 0.0, None, 0.5, 0.1, -0.6)]
    items += [("3PL", 1, None, 0.3, 0.2, None, None, None), ("GPCM", 2, 1.0, None, None, 0.4, -0.4, None), (None, 1, 1.0, 0.0, None, None, None, None), ("2PL", None, 1.0, 0.0, None, None, None, None), ("2PL", 1, 60.0, 5.0, None, None, None, None)]
    rows = [(f"i{n}-{k}", group, *item) for k, group in enumerate(["a"] * 40 + ["b", None, "c", "d"]) for n, item in enumerate(items)]
    df = spark.createDataFrame(rows, "item_key string, calibration string, irt_model string, scaled_points int, slope double, location double, guessing double, step1 double, step2 double, step3 double")
    found = {(r["calibration"], r["score"], r["g"]): (r["total"], r["items"]) for r in curves.log_probability_totals(df, ["calibration"], 0.5).collect()}
    grid = T.log_probability_grid(df, step=0.5).join(df.select("item_key", "calibration"), "item_key")
    wanted = grid.groupBy("calibration", "score", F.round((F.col("theta") + 6) / 0.5).cast("int").alias("g")).agg(F.sum("log_probability").alias("total"), F.count("*").alias("items")).collect()
    assert len(wanted) == len(found) == 5 * 4 * 25
    for r in wanted:
        total, n = found[r["calibration"], r["score"], r["g"]]
        assert n == r["items"] and total == pytest.approx(r["total"], abs=1e-6)
    plan = curves.log_probability_totals(df, ["calibration"])._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan  # no row per item and ability


def test_files_check_their_rules(spark, tables):
    from thetaloom.plans.items import released_records

    records = released_records(tables).limit(5)
    path = new_path(spark, "items")
    files.write_items(records.unionByName(records.limit(1)).dropDuplicates(["item_id"]), path)
    assert files.read_items(spark, path).count() == 5
    with pytest.raises(files.DataError, match="repeat"):
        files.write_items(records.unionByName(records), new_path(spark, "items"))
    with pytest.raises(files.DataError, match="Fields differ"):
        files.write_items(records.drop("stem"), new_path(spark, "items"))


def test_bundle_restores_types(spark):
    df = spark.createDataFrame(
        [("high", math.inf, 1, "", dt.datetime(2020, 1, 2, 3, 4, 5, 678901)), ("none", -math.inf, None, "a\nb", None), (None, 0.1 + 0.2, 2**60, None, None)],
        "effort string, theta double, n bigint, note string, at timestamp",
    ).withColumns({"shares": F.array(F.col("theta"), F.lit(None)), "small": F.col("n").cast("decimal(30,3)")})
    levels = ["none", "low", "high"]
    bundle = files.Bundle(spark, new_path(spark, "bundle"))
    bundle.write({"board": df, "empty": df.limit(0)}, {"board": {"effort": levels}})
    again = files.Bundle(spark, bundle.root)
    board = again.read("board")
    assert board.schema.simpleString() == df.schema.simpleString() and again.read("empty").count() == 0
    assert sorted(map(tuple, board.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert again.levels("board") == {"effort": levels} and again.levels("empty") == {}
    places = {r["effort"]: r["place"] for r in board.select("effort", files.level_place(F.col("effort"), levels).alias("place")).collect()}
    assert places == {"none": 1, "high": 3, None: None}
    with pytest.raises(files.DataError, match="beyond its levels"):
        bundle.write({"board": df}, {"board": {"effort": ["none"]}})


def test_missing_embeddings(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    stored = spark.createDataFrame([(1.0,)], "x double").select(F.sha2(F.lit("b"), 256).alias("text_sha256"), F.array("x").alias("embedding"))
    assert [r["text"] for r in files.missing_embeddings(texts, stored).collect()] == ["a"]


def vectors_of(spark, rows):
    return spark.createDataFrame(list(rows.items()), "text string, embedding array<float>").select(F.sha2("text", 256).alias("text_sha256"), "embedding")


def test_vector_store(spark):
    path = new_path(spark, "vectors")
    identity = {"model": "m", "dimensions": 2}
    store = VectorStore(spark, path, identity)
    assert store.read().count() == 0
    texts = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "text string")
    assert sorted(r["text"] for r in store.missing(texts).collect()) == ["a", "b", "c"]

    def stored():
        names = {hashlib.sha256(name.encode()).hexdigest(): name for name in "abcd"}
        return {names[r["text_sha256"]]: list(r["embedding"]) for r in VectorStore(spark, path, identity).read().collect()}

    store.add(vectors_of(spark, {"a": [1.0, 0.0], "b": [0.0, 1.0]}))
    store.add(vectors_of(spark, {"b": [5.0, 5.0], "d": [2.0, 2.0]}))
    assert stored() == {"a": [1.0, 0.0], "b": [0.0, 1.0], "d": [2.0, 2.0]}
    store.add(vectors_of(spark, {"b": [6.0, 6.0]}), replace=True)
    assert stored()["b"] == [6.0, 6.0]
    assert [r["text"] for r in store.missing(texts).collect()] == ["c"]
    before = store.read()
    store.compact(texts)
    assert stored() == {"a": [1.0, 0.0], "b": [6.0, 6.0]} and before.count() == 3
    store.add(vectors_of(spark, {}))
    assert stored() == {"a": [1.0, 0.0], "b": [6.0, 6.0]}


def test_vector_store_refuses(spark):
    path = new_path(spark, "vectors")
    store = VectorStore(spark, path, {"model": "m", "dimensions": 2})
    store.add(vectors_of(spark, {"a": [1.0, 0.0]}))
    with pytest.raises(files.DataError, match="another model.*'dimensions', 2, 3"):
        VectorStore(spark, path, {"model": "m", "dimensions": 3})
    with pytest.raises(files.DataError, match="another length"):
        store.add(vectors_of(spark, {"b": [1.0]}))
    with pytest.raises(files.DataError, match="another length"):
        store.add(vectors_of(spark, {"b": None}))
    with pytest.raises(files.DataError, match="repeat"):
        store.add(vectors_of(spark, {"b": [1.0, 2.0]}).unionAll(vectors_of(spark, {"b": [1.0, 2.0]})))
    assert store.read().count() == 1


def test_saved_outputs_one_per_file(spark):
    """Records over several lines, one in each file."""
    path = new_path(spark, "saved")
    rows = [(f'{{\n  "request_id": "r{k}",\n  "output": "a\\nb",\n  "cost_usd": {k}.5\n}}',) for k in range(3)]
    spark.createDataFrame(rows, "value string").repartitionByRange(3, "value").write.option("maxRecordsPerFile", 1).text(path)
    saved = files.read_saved_outputs(spark, path).collect()
    assert sorted((r["request_id"], r["output"], r["cost_usd"]) for r in saved) == [(f"r{k}", "a\nb", k + 0.5) for k in range(3)]
    assert len({r["file_name"] for r in saved}) == 3


def test_item_violations(spark):
    good = [("A", "x"), ("B", "y")]
    rows = [
        ("fine", "multiple_choice", good, "B", 1, 1), ("key", "multiple_choice", good, "C", 1, 1), ("none", "multiple_choice", None, None, 1, None),
        ("twice", "multiple_choice", [*good, ("A", "z")], "A", 1, 1), ("essay", "constructed_response", None, None, 2, 2), ("odd", "constructed_response", None, "A", 1, 2),
    ]
    items = spark.createDataFrame(rows, "item_key string, item_type string, options array<struct<label: string, text: string>>, correct_option string, max_points int, scaled_points int")
    assert sorted(map(tuple, I.item_violations(items).collect())) == [
        ("key", "the key is not among the options"), ("none", "the key is not among the options"), ("odd", "more points in the scaling than the item has"),
        ("odd", "options or a key without a choice"), ("twice", "labels repeat"),
    ]


def test_texts_at_two_grades(spark):
    rows = [(f"i{k}", (4, 8, 12)[k % 3], "same", float(k)) for k in range(300)] + [("alone", 4, "other", 1.0), ("null", 8, None, 1.0)]
    items = spark.createDataFrame(rows, "item_key string, grade int, text string, percent double")
    found = T.texts_at_two_grades(items, "text", {"percent": F.avg("percent")}).collect()
    assert sorted((r.first_grade, r.second_grade, r.first_items, r.first_percent, r.second_percent) for r in found) == [(4, 8, 100, 148.5, 149.5), (4, 12, 100, 148.5, 150.5), (8, 12, 100, 149.5, 150.5)]


def test_answer_problems(spark):
    allowed = spark.createDataFrame([("q", "answer", "A"), ("q", "answer", "B"), ("e", "answer", None), ("e", "category_A", "Correct"), ("e", "category_B", "Correct")], "item_key string, field string, value string")
    given = [("q", "answer", "A"), ("q", "answer", "a"), ("q", "answer", None), ("e", "answer", "any text"), ("e", "answer", " "), ("e", "category_A", "Correct"), ("e", "category_B", "Partial"), ("e", "category", "Correct"), (None, "answer", "A")]
    answers = spark.createDataFrame([(n, *row) for n, row in enumerate(given)], "n int, item_key string, field string, value string")
    found = {r["n"]: r["reason"] for r in V.answer_problems(answers, allowed.unionAll(allowed)).collect()}
    assert found == {1: "not an allowed value", 2: "no output", 4: "no output", 6: "not an allowed value", 7: "unexpected field", 8: "unexpected field"}


def test_run_names(spark):
    rows = [("one", 2, "p", "m", "high", "taker"), ("one", 1, "p", "m", "low", "taker"), ("one", 3, "p", "m", "low", "student"), ("two", 1, "p", "m", "low", "taker"), ("two", 2, "q", "m", "low", "taker")]
    conditions = spark.createDataFrame(rows, "run string, at int, provider string, model string, effort string, role string")
    names = {r["run"]: r["run_name"] for r in W.run_names(conditions, "run", "at", "p-s-None").collect()}
    assert names["one"] == "p-m-low+high__taker+student__scorer-p-s-None"
    digest = hashlib.sha256(b"p-m-low|q-m-low").hexdigest()[:8]
    assert names["two"] == f"2-models-{digest}__taker__scorer-p-s-None"


def test_run_report_counts_what_waits(spark):
    submitted = spark.createDataFrame(
        [(1, "r", "b1", "completed"), (2, "r", "b1", "completed"), (3, "r", "b2", "in_progress"), (4, None, "b1", "completed")],
        "request_id int, run string, batch_id string, batch_status string",
    )
    requests = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r"), (4, None), (5, None), (6, "s")], "request_id int, run string")
    results = spark.createDataFrame([(1, 200, None, None, 0.5), (4, 500, None, None, None)], "request_id int, status_code int, error string, unusable string, cost_usd double")
    outcomes = W.collected(submitted, requests.select("request_id"), results)
    report = {r["run"]: r for r in W.run_report(outcomes, "run", submitted, requests).collect()}
    names = ["requested", "saved", "failed", "in_batches", "missing", "cost_usd"]
    assert [report["r"][n] for n in names] == [2, 1, 1, 1, 1, 0.5]
    assert [report[None][n] for n in names] == [1, 0, 1, 0, 2, None]
    assert [report["s"][n] for n in names] == [0, 0, 0, 0, 1, None]


def test_agreement_is_required(spark):
    rows = [(f"i{k}", "g", "2PL", 1.0, k / 10, 90.0 - k) for k in range(10)]
    items = spark.createDataFrame(rows, "item_key string, calibration string, irt_model string, slope double, location double, percent_correct double")
    items = items.withColumns({"guessing": F.lit(None).cast("double"), **{f"step{k}": F.lit(None).cast("double") for k in (1, 2, 3)}})
    T.require_agreement(T.implied_percent_correct(items, ["calibration"]), ["calibration"])
    turned = items.withColumn("percent_correct", 100 - F.col("percent_correct"))
    with pytest.raises(files.DataError, match="correlate below"):
        T.require_agreement(T.implied_percent_correct(turned, ["calibration"]), ["calibration"])


def test_lines_of_a_missing_page(spark):
    words = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 9.0), (1, 2.0)], "page int, center double")
    found = sorted(((r["page"] or 0, r["center"], r["line"]) for r in L.lines(words, "page", "center").collect()))
    assert found == [(0, 1.0, 0), (0, 3.0, 0), (0, 9.0, 1), (1, 2.0, 0)]


def test_missing_groups_stay_in_error_tables(spark):
    from thetaloom.operators import errors as E

    rows = [(f"i{k}", None if k % 2 else 4, "m", 1, k // 3, float(k * k % 7)) for k in range(24)]
    items = spark.createDataFrame(rows, "item_key string, grade int, irt_model string, scaled_points int, part_group int, slope double")
    left_out = E.leave_one_out(items, ["slope"]).collect()
    assert len(left_out) == 24 and {r["grade"] for r in left_out} == {None, 4}
    for r in left_out:
        rest = [x[5] for x in rows if x[1] == r["grade"] and x[4] != r["part_group"]]
        assert r["peers"] == len(rest) and r["slope_mean"] == pytest.approx(np.mean(rest))
    assert {r["grade"]: r["items"] for r in E.distribution(items, ["grade"], "slope").collect()} == {None: 12, 4: 12}
    assert {r["grade"] for r in E.box_stats(items, ["grade"], "slope").collect()} == {None, 4}
    assert E.distribution_left_out(items, "slope").count() == 24


def test_pairs_of_a_leaderboard(spark):
    from thetaloom.operators import testtaking as T

    rows = spark.createDataFrame([(c, f"i{k}", (c + k) % 2, int((c + k) % 2), 1) for c in range(3) for k in range(4 + c)], "c int, item_key string, points int, full_credit int, max_points int")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (2, 1)], "first int, second int")
    found = T.paired_rows(rows, pairs, "c").groupBy("first", "second").agg(F.count("*").alias("n"), F.sum(F.col("points_a") - F.col("points_b")).alias("d"))
    assert sorted(map(tuple, found.collect())) == [(0, 1, 4, 0), (0, 2, 4, 0), (2, 1, 5, -1)]


def test_forms_of_views_have_the_same_rows(spark, tmp_path):
    """Parts that come twice, alike and with another size, and missing keys, sizes and flags."""
    from thetaloom.sources.tables import FORMS, VIEWS, Tables

    parts = [(k, (k * 7) % 9 or None) for k in range(1, 30)] + [(9, 1), (9, 8), (12, 3), (12, 3), (None, 2)]
    lines = [(o, (o * 5) % 31 or None, (o * 11) % 7 or None, "RAN"[o % 3] if o % 8 else None) for o in range(1, 400)]
    spark.createDataFrame(parts, "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    for name in FORMS:
        own, plain = getattr(t, name), t.sql(VIEWS[name])
        assert own.schema == plain.schema and own.count() == plain.count() > 0
        assert own.exceptAll(plain).isEmpty() and plain.exceptAll(own).isEmpty()
        text = own._jdf.queryExecution().optimizedPlan().toString()
        assert not any("min(" in line and "concat" in line.split("[")[1] or "max(" in line and "calibration" in line for line in text.splitlines() if "Aggregate" in line)


def test_item_level_has_one_form(spark, tmp_path):
    """Line items are combined by their numbers alone, with the rows of the view: repeated parts, missing keys, sizes and prices."""
    from thetaloom.sources.tables import CONDITION_FORMS, VIEWS, Tables

    parts = [(k, (k * 7) % 9 or None, k * 1.5 if k % 4 else None) for k in range(1, 30)] + [(9, 1, 2.0), (9, 8, 3.0), (12, 3, 1.0), (12, 3, 1.0), (None, 2, 5.0)]
    lines = [(o, (o * 5) % 31 or None, (o * 11) % 17 or None, "RAN"[o % 3] if o % 8 else None) for o in range(1, 400)]
    spark.createDataFrame(parts, "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s or None,) for s in (*range(13), 3)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    t = Tables(spark, str(tmp_path))
    for name in CONDITION_FORMS:
        own, plain = getattr(t, name), t.sql(VIEWS[name])
        assert own.schema == plain.schema and own.count() == plain.count() > 0
        assert own.exceptAll(plain).isEmpty() and plain.exceptAll(own).isEmpty()
        text = own._jdf.queryExecution().optimizedPlan().toString()
        assert not any("max(" in line and "concat" in line for line in text.splitlines() if "Aggregate" in line)


def test_cells_have_one_form(spark):
    """The cells that take a line item once are those of the query's SQL."""
    from thetaloom.plans.ledger import CELLS_FORM, CELLS_SQL
    from thetaloom.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    one, other = t.sql(CELLS_FORM), t.sql(CELLS_SQL)
    assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0


def test_cells_of_a_sheet_are_joined_once(spark):
    """The items of the columns come by a window: one join, of the cells with the labels of their rows."""
    from thetaloom.operators.layout import block_percent_correct

    cells = spark.createDataFrame([("S", 1, 0, "Item classification"), ("S", 1, 1, "Number (M1)")], "sheet string, sheet_row int, col int, value string")
    plan = block_percent_correct(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_reference_means_join_totals(spark):
    """Targets that come twice or with two kinds, missing kinds and values; the references are joined once, their totals after."""
    from thetaloom.operators.errors import reference_means

    items = spark.createDataFrame([("a", "2PL", 1, 1.0), ("a", "2PL", 1, 1.0), ("b", "2PL", 1, 2.0), ("b", "3PL", 1, 8.0), ("c", "2PL", 1, None), ("d", None, 1, 5.0), ("e", "2PL", 1, 4.0)], "item_key string, irt_model string, scaled_points int, slope double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "e"), ("b", "a"), ("b", "c"), ("e", "c"), ("d", "a"), (None, "a")], "target_key string, item_key string")
    found = reference_means(pairs, items, ["slope"])
    assert sorted(map(tuple, found.collect())) == [("a", 3.0, 4), ("b", 1.0, 3), ("e", None, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [target_key") >= 2


def test_references_are_not_sorted(spark):
    """Both joins hash their small side, and other kinds than the target's are gone before the sums."""
    from thetaloom.operators.errors import reference_means

    items = spark.createDataFrame([("a", "2PL", 1, 1.0), ("b", "2PL", 1, 2.0), ("b", "2PL", 1, 2.0), ("b", "3PL", 1, 8.0), ("c", "2PL", 1, None)], "item_key string, irt_model string, scaled_points int, slope double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("b", "b"), ("c", "c")], "target_key string, item_key string")
    found = reference_means(pairs, items, ["slope"])
    assert sorted(map(tuple, found.collect())) == [("a", round(5 / 3, 12), 4), ("b", 3.2, 5), ("c", None, 1)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
