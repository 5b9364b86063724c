"""Manifest, whitening and fingerprints against brute-force versions, and their defined results for odd input; keys of other types; odd pages."""

from __future__ import annotations

import hashlib
import itertools
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantrail.llm import bpe_trie, common, fingerprints, html_blocks, merkle_manifest, queries, suffix_array, topk, whitening


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each node the digests left and right of its ancestors."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in nodes]
    height = 0
    while len(nodes) > 1:
        for i, proof in enumerate(proofs):
            at = i // 3**height
            proof.append(("".join(nodes[at // 3 * 3 : at]), "".join(nodes[at + 1 : at // 3 * 3 + 3])))
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
        height += 1
    return nodes[0], proofs


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        bad = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        groups[source].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, bad)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([x[2] for x in groups[s]]) for s in names if groups[s].sort() is None}
    root, tops = climbed([trees[s][0] for s in names]) if names else ("", [])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (known, doc_id, own, claim), below in zip(groups[s], trees[s][1], strict=True):
            node = claim
            for left, right in below + top:
                node = sha(left + node + right)
            out.append((doc_id if known else None, own, trees[s][0], root, sha("".join(a + b for a, b in below + top)), node, node == root))
    return sorted(out, key=repr)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def of(spark, rows, tmp_path, name="documents", schema=DOCS):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_manifest(spark, sf_dir):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in common.table(spark, sf_dir, "documents").collect()]
    assert sorted((tuple(r[c] for c in MANIFEST) for r in queries.op11_merkle_manifest(spark, sf_dir).collect()), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize("sizes", [(1,), (3, 1, 2), (243, 244, 1), (729, 730)])
def test_manifest_of_group_sizes_around_blocks(spark, tmp_path, sizes):
    """One row, whole runs, whole blocks and one more; a null source beside an empty one."""
    names = [None, "", "z", "é"]
    rows = [(i, f"t{i}\nx", "en", names[k], i) for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)]
    got = queries.op11_merkle_manifest(spark, of(spark, rows, tmp_path)).collect()
    assert sorted((tuple(r[c] for c in MANIFEST) for r in got), key=repr) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, keys with several texts, repeated rows, no rows; inner names clash with nothing."""
    rows = [(1, None, None, None, None), (None, "a\nb", "en", "s", 3), (2, "", "en", "s", 0), (2, "x\n" * 50_000, "en", "s", 9), (2, "x\n" * 50_000, "en", "s", 9), (-5, "é漢\n", "de", None, 3), (None, None, "fr", "", 1)]
    got = queries.op11_merkle_manifest(spark, of(spark, rows, tmp_path)).collect()
    assert sorted((tuple(r[c] for c in MANIFEST) for r in got), key=repr) == brute_manifest(rows)
    none = of(spark, [], tmp_path / "none")
    assert queries.op11_merkle_manifest(spark, none).collect() == []
    keyed = spark.createDataFrame([("b", "g", sha("1"), 5), ("a", "g", sha("2"), 6)], "name string, __row string, d string, root_ int")
    done = {r.name: r for r in merkle_manifest.manifest(keyed, "__row", "name", "d").collect()}
    assert done["a"].root == sha(sha("2") + sha("1")) and done["a"].root_ == 6 and done["b"].proof[0].left == [sha("2")] or done["b"].proof[0]["left"] is not None


def test_siblings_of_other_fanouts():
    for n, fanout in itertools.product((1, 2, 7, 16, 17), (2, 4)):
        rows = merkle_manifest.levels(np.frombuffer("".join(sha(str(i)) for i in range(n)).encode(), np.uint8).reshape(-1, 64), True, fanout, 9)
        root = rows[-1].tobytes().decode()
        for i, s in enumerate(merkle_manifest.siblings(rows, fanout).to_pylist()):
            node = sha(str(i))
            for left, right in zip(s["left"], s["right"], strict=True):
                node = sha(f"{left}{node}{right}")
            assert node == root


def whitened(rows: list[tuple], most: int = 32):
    x = np.array([[np.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows])
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return x.astype(np.int64), centred, values[::-1][:most], vectors[:, ::-1][:, :most], np.trace(centred.T @ centred / len(x))


def test_whitening(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, sf_dir, "embeddings").collect()]
    rows = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    x, centred, values, vectors, trace = whitened(rows)
    got = defaultdict(dict)
    for r in queries.op12_whitening(spark, sf_dir).collect():
        got[r.vec_id][r.component] = r
    n, sums = len(rows), x.sum(0).tolist()
    assert {*got} == {r[0] for r in rows} and all({*g} == set(range(1, len(values) + 1)) for g in got.values())
    scores = np.array([[got[k][c + 1].whitened for c in range(len(values))] for k, _ in rows])
    want = centred @ vectors / np.sqrt(values)
    gaps = np.abs(np.diff(values)) / values[0]
    apart = [i for i in range(len(values) - 1) if gaps[i] > 1e-4 and (i == 0 or gaps[i - 1] > 1e-4)]
    assert len(apart) > 20
    for i in apart:
        sign = np.sign(scores[:, i] @ want[:, i])
        assert np.abs(sign * scores[:, i] - want[:, i]).max() < 1e-7
    for (k, _), row in zip(rows, x.tolist(), strict=True):
        r = got[k][1]
        assert (r.n, r.deviation) == (n, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)))
        assert r.explained == pytest.approx(values[0] / trace, rel=1e-9) and r.identity_error < 1e-9


def test_components_of_a_steep_wide_table(spark):
    """More dimensions than the blocks span, so several passes: values over eight orders and a pair that nearly ties."""
    rng = np.random.default_rng(3)
    d, n = 160, 1200
    scale = 2.0 ** np.linspace(8, -1, d)
    scale[1] = scale[0] * 0.999
    data = (rng.standard_normal((n, d)) * scale) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = whitening.fixed_points(df)
    found = whitening.fit_components(rows, 20)
    x = np.floor(64 * data) + 1_000_000
    c = x - x.mean(0)
    cov = c.T @ c / n
    assert found.passes > 3 and found.residual <= whitening.GOAL
    assert found.values == pytest.approx(np.linalg.eigvalsh(cov)[::-1][:20], rel=1e-11)
    assert np.abs(cov @ found.vectors - found.vectors * found.values).max() < 1e-9 * found.values[0]
    assert whitening.identity_error(rows, found) < 1e-8


def test_whitening_of_odd_vectors(spark, tmp_path):
    """Nulls, entries that are null or not finite or too large, short and empty vectors take no part; repeated rows and null keys do."""
    bad = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e300, 1.0, 1.0], [1.0, 2.0], []]
    good = [[1.0, 2.0, 3.5], [1.0, 2.0, 3.5], [-4.0, 0.0, 1.0], [2.0, 2.0, -2.0], [0.5, -7.0, 1.0]]
    rows = [(i, v, 1) for i, v in enumerate(bad)] + [(None if i == 4 else 50, v, 2) for i, v in enumerate(good)]
    kind = "vec_id long, embedding array<double>, x int"
    got = queries.op12_whitening(spark, of(spark, rows, tmp_path, "embeddings", kind)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in got) == sorted((k is None, k, c) for k in (50, 50, 50, 50, None) for c in (1, 2, 3))
    assert {r.n for r in got} == {5} and max(r.identity_error for r in got) < 1e-9
    for name, some in (("none", rows[:0]), ("bad", rows[:7]), ("equal", rows[7:9]), ("flat", [(1, [1.0, 2.0], 0)])):
        assert queries.op12_whitening(spark, of(spark, some, tmp_path / name, "embeddings", kind)).collect() == []
    line = queries.op12_whitening(spark, of(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 6.0], 0), (3, [5.0, 10.0], 0)], tmp_path / "line", "embeddings", kind)).collect()
    assert [r.component for r in line] == [1, 1, 1] and [r.explained for r in line] == pytest.approx([1.0] * 3)


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert whitening._deviations(x, 1 << 20, np.array([0, 0], object)).to_pylist() == [None, 25 << 40]


def test_fingerprints_query_by_sql(spark, sf_dir):
    """The SQL of the query on the smallest tables, all columns."""
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        for name, sql in (("op13_fingerprints", queries.OP13_SQL), ("op11_merkle_manifest", queries.OP11_SQL)):
            df = queries.queries()[name](spark, sf_dir)
            want = con.sql(sql)
            assert sorted(df.columns) == sorted(want.columns)
            assert sorted(tuple(r) for r in df.collect()) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall())


def test_next_documents(spark):
    """Keys that repeat, a null key, equal rows, null and empty texts: every row has a next one, in a single ring."""
    rows = [(3, "c"), (3, "C"), (3, "c"), (None, "n"), (9, None), (1, ""), (7, "g\nh"), *((100, "same") for _ in range(50))]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    following = {r.doc_id: r.next_text for r in got if r.doc_id in (9, 7, 1, None)}
    assert following[9] == "g\nh" and following[7] in ("c", "C") and following[1] == "n" and following[None] == "same"
    assert sorted(r.next_text for r in got) == sorted(t or "" for _, t in rows)  # each text follows one other
    assert {r.next_text for r in got if r.doc_id == 100} == {"same", ""}
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = fingerprints.with_next(spark.createDataFrame([("k", "x")], "fingerprint_ string, t string").toDF("key", "t"), "key", "t").collect()
    assert [(r.key, r.t, r.next_text) for r in one] == [("k", "x", "x")]
    with pytest.raises(ValueError, match="fingerprint"):
        fingerprints.with_next(spark.createDataFrame([("k", "x")], "fingerprint string, t string"), "fingerprint", "t")


def test_fingerprints_tell_texts_apart_and_locate_edits(spark):
    lines = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    changed = [*lines]
    changed[17] = changed[17].replace("w17x12", "other")
    moved = [*lines[20:], *lines[:20]]
    texts = ["\n".join(lines), "\n".join(changed), "\n".join(moved), "unlike this", "", None, "a\x01b", "ab", "a\x01\x01b", "a\n\nb", "a\nb", "漢字かな" * 500, " \t", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", fingerprints.fingerprint(F.col("t")).alias("f"))
    f = {r.i: r.f for r in df.collect()}
    assert f[4] == f[5] and len({*f.values()}) == len(texts) - 1 and len({x[:64] for x in f.values()}) == len(texts) - 1
    pairs = spark.createDataFrame([(f[a], f[b], a, b) for a in f for b in f], "x string, y string, a int, b int")
    near = {(r.a, r.b): r for r in pairs.select("a", "b", fingerprints.likeness(F.col("x"), F.col("y")).alias("n"), fingerprints.edits(F.col("x"), F.col("y")).alias("e")).collect()}
    assert all(r.n == near[b, a].n and 0 <= r.n <= 1 for (a, b), r in near.items()) and all(near[a, a].n == 1 and not near[a, a].e for a in f)
    assert 0.95 < near[0, 1].n < 1 and near[0, 2].n > 0.95 and near[0, 3].n < 0.05 and near[4, 5].n == 1
    assert [e.paragraph for e in near[0, 1].e] == [near[1, 0].e[0].paragraph] and len(near[0, 1].e) == 1 and len(near[0, 3].e) == 40


def test_passages_of_text_keys(spark, sf_dir):
    """Keys that are no numbers: passages name their source by it, and the pipeline's stage keeps every row."""
    words = " ".join(f"word{i}" for i in range(80))
    rows = [("b1", f"one {words} two"), ("a1", f"three {words} four"), ("c1", "short"), (None, words)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = suffix_array.passage_rows(df).collect()
    assert {r.doc_id for r in found} == {"a1", "b1", None} and all(r.source_id is None or isinstance(r.source_id, str) for r in found)
    kept = dict(corpus_pipeline.STAGES)["repeated_passages"](spark, df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")), sf_dir).collect()
    assert {r.doc_id for r in kept} == {"a1", "b1", "c1", None} and sum(words in r.text for r in kept) == 1


def test_pages_that_end_early_or_nest_deeply():
    of = lambda page: [b.text for b in html_blocks.blocks_of(page)]
    assert of('<p>a</p><script src="a.js" /> var x=1; </script><p>b</p><svg/>c<svg><g/>no</svg>d<!-- x') == ["a", "b", "c d"]
    assert of("x<!-- no > no") == ["x"] and of("x<!-- no --> y <!-- no") == ["x y"] and of("<p>a<script>x > y") == ["a"] and of("<p>a</p> b <a foo") == ["a", "b <a foo"]
    began = time.time()
    deep = html_blocks.blocks_of("<div>x" * 40_000)
    assert len(deep) == 40_000 and html_blocks.path_means([b.path for b in deep], np.ones((html_blocks.PATHS, 2))).tolist() == [[1.0, 1.0]] * 40_000
    for page in ("<a " * 100_000, "<div>" * 50_000 + "</span>" * 50_000, "<!--" * 50_000, '<a "' * 50_000):
        html_blocks.blocks_of(page)
    assert time.time() - began < 20


def test_words_remembered_by_bytes():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    small = bpe_trie.TrieEncoder(path, "bytes", 100_000)
    texts = [" ".join(f"{a}{b}{i}" for a in "abc" for b in "xyz") for i in range(300)]
    assert [*small.packed(texts)] == [*bpe_trie.TrieEncoder(path, "bytes").packed(texts)]
    for t in texts:
        [*small.packed([t])]
    assert len(small.known) * 180 < 150_000


def test_search_by_text_keys(spark):
    """Keys that are no numbers: every row may ask, ties go to the smaller key."""
    rng = np.random.default_rng(2)
    rows = [(f"k{i:02d}", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(40)]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), 3, every=1).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for k, v in rows:
        all_ = sorted((-int(256 * 256 * np.dot(v, w)), j) for j, w in rows if j != k)
        assert got[k] == [(j, -s) for s, j in all_[:3]]
