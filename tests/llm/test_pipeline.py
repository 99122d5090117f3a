"""The pipeline's stages on the smallest documents, each against its own input."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline as P
from visitlens.llm import ngram_join
from visitlens.llm.common import stored, table
from visitlens.llm.queries import ORACLES, QUERIES


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, [docs]
    for _, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns
        seen.append(docs)
    assert seen[1].count() >= 0.95 * seen[0].count()
    kept = {r.doc_id for r in seen[2].collect()}
    assert kept == {r.component_id for r in ngram_join.near_duplicates(seen[1]).collect()}
    assert P.substring.remove_repeats(seen[3]).where("n_removed > 0").isEmpty()
    again = collections.Counter(r.doc_id for r in seen[4].collect())
    assert max(again.values()) <= 2
    pieces = P.pack_sequences(spark, docs, sf).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert P.ORACLE_SQL is None and "pipeline" in P.QUERIES


def test_null_and_repeated_ids(spark, sf):
    """Every row counts by itself, whatever its id: clean rows without an id stay, of
    copies one row stays, and a row is mixed in as often as the plan says."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    near = text["c"] + " more"
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (1, text["c"]), (1, text["c"]), (5, near), (5, text["d"]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, text["a"]), (None, text["b"]), (1, text["c"]), (5, text["d"]), (None, None)], key=str)

    plan = collections.Counter()
    for r in P.mixing.mix(docs).collect():
        plan[r.doc_id] += r.taken
    taken = collections.Counter()
    for r in P.mix_sources(spark, docs, sf).collect():
        taken[r.doc_id] += len(r.text.split())
    assert plan[None] and plan[1] and taken == plan


def test_extra_columns_with_clashing_names(spark, sf):
    """Columns called as the operators' own, inner or outer, come through all stages."""
    names = ["score", "size", "doc", "n_words", "row", "row_key", "taken", "piece", "sid", "firsts", "margin", "kept_text"]
    docs = table(spark, sf, "documents").limit(200)
    plain = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    out = plain
    for _, stage in P.STAGES[:-1]:
        out = stored(stage(spark, out, sf), "test-clash")
        assert out.columns == plain.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert P.pack_sequences(spark, out, sf).count() >= len(rows)


def test_empty(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_queries_with_sql_match(spark, sf, duck):
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, sf), duck.sql(sql)
        columns, names = sorted(got.columns), list(want.columns)
        assert columns == sorted(names), name
        a = sorted(tuple(r[c] for c in columns) for r in got.collect())
        b = sorted(tuple(dict(zip(names, r))[c] for c in columns) for r in want.fetchall())
        assert a == b, name
