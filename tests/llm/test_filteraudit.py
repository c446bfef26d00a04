import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa

from dialectic.llm import filteraudit as fa
from dialectic.llm.queries import ORACLE, op13_filter_audit
from tests.llm.helpers import docs, rows

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_failures(table):
    out = []
    for i, t, _ in table:
        t = t or ""
        words = WORD.findall(t)
        out.append({f for f, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)),
            any(u is not None and i is not None and u < i and (s or "") == t for u, s, _ in table))) if bad})
    return out


def plain_audit(table, good, toxic):
    """Every order applied document by document."""
    fails, out = plain_failures(table), {}
    for part in {p or "" for _, _, p in table}:
        of = [(i, f) for (i, _, p), f in zip(table, fails) if (p or "") == part]
        first = {}
        for order in permutations("ABCDE"):
            left = of
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x for _, x in of) - len(gone), sum(x == {f} for _, x in of),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                first[f] = first.get(f, 0) + len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(first[order[step - 1]])
    return out


def strange_table(seed=4, n=160):
    rnd = random.Random(seed)
    words = ["a", "b", "B", "cat", "DOG", "é", "日本", "x|y", "5%", "\xa0", "#"] + [f"w{i}" for i in range(80)]
    texts = [None, "", " ", "\x0b\x0c a\tb\r\n", "A", "x" * 20_000] + [
        rnd.choice([" ", "\n", " \t"]).join(rnd.choices(words, k=rnd.choice([3, 49, 50, 51, 90]))) for _ in range(30)]
    return [(rnd.choice([i, i, i, None, 7]), rnd.choice(texts), rnd.choice(["s", "t", None, ""])) for i in range(n)]


def frame(spark, table):
    return spark.createDataFrame(table, "doc_id long, text string, source string").selectExpr(
        "*", "1 as fails", "text as word", "2 as shard", "3 as good", "4 as part", "5 as digest").repartition(5)


def test_audit_equals_every_order_by_hand(spark):
    table = strange_table()
    labels = [(i, i % 3 if i % 5 else None, i % 2) for i in range(0, 160, 2)] + [(None, 1, 1), (8, 1, 0), (8, 0, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as part")
    got = {tuple(r)[:3]: list(tuple(r)[3:]) for r in fa.audit(frame(spark, table), marks).collect()}
    assert got == plain_audit(table, good, toxic)


def test_query_equals_its_sql(spark, tmp_path):
    sf = tmp_path
    table = strange_table(9, 120)
    spark.createDataFrame(table, "doc_id long, text string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (3, 0, 1), (7, 1, 1), (None, 1, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet/*.parquet'")
    got = op13_filter_audit(spark, str(sf))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE['op13_filter_audit']})").fetchall()
    assert sorted(rows(got)) == sorted(want)


def test_matrix_holds_every_word_once(spark):
    table = strange_table(6, 60)
    shards, numbered = fa.term_matrix(frame(spark, table))
    word_of = {r.col: r.word for r in numbered.collect()}
    assert sorted(word_of) == list(range(len(word_of)))
    seen = []
    for s in shards.collect():
        columns = fa.columns_of(np.array(s.columns, np.int64)).tolist()
        for k, i in enumerate(s.doc_id):
            cells = range(s.starts[k], s.starts[k + 1])
            seen.append((str(i), sorted(w for c in cells for w in [word_of[columns[s.cols[c]]]] * s.counts[c])))
    assert sorted(seen) == sorted((str(i), sorted(WORD.findall(t or ""))) for i, t, _ in table)


def test_a_shard_is_several_small_rows(spark, monkeypatch):
    monkeypatch.setattr(fa, "SHARD_BYTES", 4000)
    monkeypatch.setattr(fa, "PIECE_BYTES", 500)
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(60)], k=rnd.choice([0, 3, 40, 70]))) for _ in range(200)] + ["x y " * 400]
    shards, numbered = fa.term_matrix(docs(spark, texts).coalesce(1))
    word_of, of = {r.col: r.word for r in numbered.collect()}, {}
    assert len(word_of) == len(set(" ".join(texts).split()))
    for s in shards.collect():
        assert len(s.doc_id) == 1 or sum(len(texts[i]) + 1 for i in s.doc_id) <= 500
        columns = fa.columns_of(np.array(s.columns, np.int64))
        assert {word_of[columns[c]] for c in s.cols} == set(" ".join(texts[i] for i in s.doc_id).split())
        of.setdefault(s.shard, []).append(s)
    assert len(of) < 10 and max(map(len, of.values())) > 5
    assert all(len({tuple(s.columns) for s in x}) == 1 and 0 in [s.first_column for s in x] for x in of.values())
    got = {r.doc_id: (r.n_words, r.n_distinct) for r in fa.matrix_rows(shards).collect()}
    assert got == {i: (len(t.split()), len(set(t.split()))) for i, t in enumerate(texts)}


def test_pieces_are_numbered_as_one():
    texts = pa.array(["b a b", "", "c a", "a\x0bc d", "b"], pa.large_string())
    *whole, words = fa.compressed_rows(texts)
    pieces, same_words = fa.compressed_pieces([texts[:2], texts[2:3], texts[3:]])
    assert words.equals(same_words)
    assert [x for _, cols, _ in pieces for x in cols.tolist()] == whole[1].tolist()
    assert [x for _, _, counts in pieces for x in counts.tolist()] == whole[2].tolist()
    assert [starts.tolist() for starts, _, _ in pieces] == [[0, 2, 2], [0, 2], [0, 3, 4]]


def test_rows_of_a_slice():
    starts, cols, counts, words = fa.compressed_rows(pa.array(["b a b", "", " \n", "a\x0bc"], pa.large_string()))
    assert starts.tolist() == [0, 2, 2, 2, 4] and counts.tolist() == [2, 1, 1, 1]
    assert [words[c].as_py() for c in cols] == ["b", "a", "a", "c"]
    assert fa.compressed_rows(pa.array([], pa.large_string()))[0].tolist() == [0]


def test_hot_texts_and_empty_tables(spark, monkeypatch):
    table = [(i, "same text" if i % 2 else f"text {i % 20}", "s") for i in range(200)] + [(None, "same text", "s")] * 3
    want = [sorted(x) for x in plain_failures(table)]
    for most in (1, 4096):
        monkeypatch.setattr(fa, "MAX_HOT", most)
        got = {}
        for r in fa.failing(frame(spark, table)).collect():
            got.setdefault(r.doc_id, []).append(["ABCDE"[b] for b in range(5) if r.fails >> b & 1])
        assert all(got[i].pop() == w for (i, _, _), w in zip(table, want)) and not any(got.values())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    wordless = fa.audit(docs(spark, [None, "", " "]), labels)
    assert wordless.filter("filter_order = 'EABCD'").orderBy("step").select("removed").collect() == [(1,), (2,), (0,), (0,), (0,)]
    assert rows(fa.audit(docs(spark, []), labels)) == []
