"""Every pipeline stage on tables with nulls, repeats and columns of any name."""

import time

import corpus_pipeline as cp
from dialectic.llm import decontaminate, language, pii
from tests.llm.helpers import docs

CLASHES = ["_hash", "_id", "_row", "_kept_hash", "_hits", "_items", "_n_words", "_lang", "_score", "_LANG", "_was", "found"]
ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs away from them all over the hill "


def tables(spark, tmp_path, texts, ids=None):
    d = docs(spark, texts, ids)
    for i, c in enumerate(CLASHES):
        if c.lower() not in [x.lower() for x in d.columns]:
            d = d.selectExpr("*", f"concat('u{i}-', doc_id) AS `{c}`")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    return d


def test_stages_keep_the_columns_they_are_given(spark, tmp_path):
    texts = [ENGLISH * 3, ENGLISH * 3, None, "", "write to a.b@example.org " + ENGLISH * 2,
             "x one two three four five six seven eight nine ten eleven y", ENGLISH + "12 34"]
    d = tables(spark, tmp_path, texts, [0, 1, 2, 3, 4, 5, 6])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        for i, r in rows.items():
            assert r["_hash"] == f"u0-{i}" and all(r[c] is not None for c in out.columns if c not in ("text", "n_chars")), name
        if name == "near_duplicates":
            assert 0 in rows and 1 not in rows and 2 in rows and 3 not in rows
        if name == "decontamination":
            assert sorted(rows) == [0, 1, 2, 3, 4, 6]
        if name == "pii":
            assert len(rows) == 7 and "[EMAIL]" in rows[4].text and rows[4].n_chars == len(rows[4].text)
            assert rows[2].text is None
        if name == "language":
            assert 2 not in rows and 3 not in rows
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    packed = cp.STAGES[-1][1](spark, d, str(tmp_path))
    assert sum(r.length for r in packed.collect()) > 0 and cp.STAGES[-1][1](spark, d.limit(0), str(tmp_path)).count() == 0


def test_equal_id_and_text_leave_one_row_by_rule(spark, tmp_path):
    d = docs(spark, ["same text here"] * 4, [3, 3, 3, 9]).drop("source").selectExpr("*", "lang AS _hash")
    d = d.unionByName(d.selectExpr("doc_id", "text", "lang", "n_chars", "'other' AS _hash"))
    got = [cp.near_duplicates(spark, d.repartition(n), str(tmp_path)).collect() for n in (1, 3, 5)]
    assert all(len(g) == 1 and g[0].doc_id == 3 and g[0] == got[0][0] for g in got)


def test_added_names_are_free():
    assert language.added_names(["a", "_LANG"]) == ("__lang", "_score")
    assert decontaminate.added_names(["_hits", "__hits"])[1] == "___hits"


def test_many_numbers_in_one_text():
    text = "\n".join(f"call 555-{i % 900 + 100}-{i % 9000 + 1000} now" for i in range(100_000))
    begun = time.time()
    spans = pii.find_spans(text)
    assert len([s for s in spans if s.kind == "tel"]) > 50_000 and time.time() - begun < 20
