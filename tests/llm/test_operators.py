"""Each operator against a brute-force version on small tables, and its defined results for odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quantrail.llm import bpe_trie, common, html_blocks, html_pages, ngram_join, packing, pii, quality, queries, sharding, suffix_array, topk, unigram_lm

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row long, size long, shard int, key string, kept boolean"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and equal texts, repeated rows and column names that operators use themselves."""
    words = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", " \n\t", words, words, words + " end", "x " * 30_000, "a b   ﬁ İ ß 漢字 <|endoftext|> \x85", None]
    rows = [(i if i < 7 else None, t, "en", "s", len(t or ""), 1, 2, 3, "k", True) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3]], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def spans(text):
    """Base spans by the plain patterns."""
    out = []
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(n := re.sub(r"\D", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(n[::-1])) % 10 == 0,
        "phone": lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15,
    }
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, (kind, p) in enumerate(patterns.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, text or "") if ok[kind](m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_pii(spark, sf_dir, docs):
    got = {r.doc_id: r.base_sha256 for r in queries.op1_pii(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(spans(t).encode()).hexdigest() for i, t in docs}


@pytest.mark.parametrize("text", ["a@b@c.de x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111-1111 1111 1", "+49 (0) 123 456-78 +1", "@a.b c@d.e.f@g.h", "..%@-.-"])
def test_pii_of_hard_cases(text):
    assert ",".join(f"{k}:{a}:{b}" for k, a, b, _ in pii.find(text) if k in pii.KINDS[:4]) == spans(text)


def test_pii_kinds_and_redaction():
    text = "IBAN DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01, mail a@b.co"
    assert [s[0] for s in pii.find(text)] == ["iban", "email"]
    assert pii.redacted(text, pii.find(text)) == "IBAN <IBAN> and DE89 3704 0044 0532 0130 01, mail <EMAIL>"


def test_pii_of_a_long_secret():
    for n in (16, 128, 129, 5000):
        assert [(k, b - a) for k, a, b, _ in pii.find(f'api_key = "{"aB3" * n}"'[: n + 11] + '"')] == [("secret", n)]


def test_pii_redaction_of_overlapping_spans(spark):
    known = {
        "ip 10.0.0.0 4111111111111111 end": "ip <IP> end",
        "call +1 555 123 4567bob@x.com now": "call <PHONE> now",
        "+1 555 123 4567bob@x.com, a@b.co": "<PHONE>, <EMAIL>",
    }
    for text in known:
        found = pii.find(text)
        assert any(a[1] < b[1] < a[2] < b[2] for a in found for b in found)
    rows = spark.createDataFrame([(t,) for t in known], "text string")
    assert {r.text for r in pii.redact(rows).collect()} == set(known.values())
    # chains, spans inside others and spans that touch
    assert pii.redacted("abcdefghij", [("ip", 0, 3, 1.0), ("card", 2, 5, 1.0), ("phone", 4, 7, 1.0)]) == "<IP>hij"
    assert pii.redacted("abcdefghij", [("ip", 0, 8, 1.0), ("card", 2, 4, 1.0), ("phone", 7, 9, 1.0)]) == "<IP>j"
    assert pii.redacted("abcdefghij", [("ip", 0, 3, 1.0), ("card", 3, 5, 1.0)]) == "<IP><CARD>fghij"


def test_html_held_out_pages():
    model, right, total = html_blocks.trained(), 0, 0
    for page, labels in html_pages.training_pages(200, seed=2):
        blocks = html_blocks.blocks_of(page)
        kept = set(html_blocks.main_texts([page], model)[0].split("\n"))
        right += sum((b.text in kept) == bool(labels[b.text]) for b in blocks if b.text in labels)
        total += sum(b.text in labels for b in blocks)
    assert right / total > 0.97


def test_html_odd_pages():
    assert html_blocks.main_texts([None, "", "<!-- <p>x"], html_blocks.trained()) == ["", "", ""]
    assert html_blocks.main_texts(["<p"], html_blocks.trained())[0] in ("", "<p")  # no tag: text, if main
    assert [b.text for b in html_blocks.blocks_of("<p>a &amp;\n b<br>c<script>x</script><li>d")] == ["a & b c", "d"]


def article_of(page):
    """The text of a page of the table, whose main text is its one article, by plain patterns."""
    import html

    parts = re.split(r"</?(?:h[1-6]|p|li|ul|ol|div|blockquote|pre|table|tr|td|section)\b[^>]*>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_html_pages_of_the_table(spark, sf_dir):
    pages = {r.page_id: r for r in common.table(spark, sf_dir, "pages").collect()}
    rows = queries.op2_html_blocks(spark, sf_dir).collect()
    assert len(rows) == len(pages) >= 50
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article_of(pages[r.page_id].html), len(r.text))


def test_html_of_odd_tables(spark):
    """Nulls, empty pages, repeated rows, a page of very many blocks, clashing names, no rows."""
    long = "<article>" + "".join(f"<p>Paragraph number {i} of a long article, with words enough.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, None, "t"), (2, "", "t"), (3, "<article><p>One sentence of text.</p><p>Two.</p></article>", "t"), (3, "<article><p>One sentence of text.</p><p>Two.</p></article>", "t"), (4, long, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    model = spark.sparkContext.broadcast(html_blocks.trained())
    got = [tuple(r) for r in df.select("page_id", html_blocks.extracted("html", model).alias("x")).select("page_id", "x.*").orderBy("page_id").collect()]
    assert got[:2] == [(1, "", 0), (2, "", 0)] and got[2] == got[3]
    assert got[4][1].count("\n") == 19_999
    assert df.filter("false").select(html_blocks.extracted("html", model).alias("x")).count() == 0
    assert [b.text for b in html_blocks.blocks_of("<div/>a<p><a href=/x/>b</a></p>")] == ["a", "b"]


def test_html_groups_are_bounded(monkeypatch):
    pages = [p for p, _ in html_pages.training_pages(40, seed=5)]
    known = html_blocks.main_texts(pages, html_blocks.trained())
    monkeypatch.setattr(html_blocks, "CELLS", 50)
    monkeypatch.setattr(html_blocks, "STRIDE", 3)
    assert html_blocks.main_texts(pages, html_blocks.trained()) == known


def test_html_custom_elements_are_no_raw_ones():
    for name in ("svg-icon", "video-player", "title-bar", "select-menu", "style-guide", "object-view", "template-x"):
        page = f'<article><{name} name="x">in</{name}><p>First paragraph.</p><p>Second.</p></article><svg><text>no</text></svg>'
        assert [b.text for b in html_blocks.blocks_of(page)] == ["in", "First paragraph.", "Second."]
    assert [b.text for b in html_blocks.blocks_of("<svg/><p>a<SCRIPT\nsrc=x>no</script></p><style>no</style>b")] == ["a", "b"]


def test_html_blocks_go_on_behind_raw_elements():
    of = lambda page: [b.text for b in html_blocks.blocks_of(page)]
    assert of("<p>foo <script>x</script> bar <math>x=1</math> end</p>") == ["foo bar x=1 end"]
    assert of("<p>fo<script>x</script>o<svg><path/></svg>bar <select><option>no</select>end<style>p{}</style><p>next") == ["foo bar end", "next"]
    assert of("<p>let <math><mi>y</mi><mo>&lt;</mo><mn>2</mn></math> be</p><script>no</script>") == ["let y<2 be"]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, sf_dir):
    rows = queries.op3_sharding(spark, sf_dir).collect()
    slots = defaultdict(list)
    for r in rows:
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 8), jump(key, 9))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def grams(text):
    words = SPACE.findall(text or "")
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def test_ngram_join(spark, sf_dir, docs):
    sets = {i: grams(t) for i, t in docs}
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x == y or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9):
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op4_ngram_join(spark, sf_dir).collect()}
    assert got == {i: (find(i), links[i]) for i in sets}


def test_packing(spark, sf_dir, docs, tokenizer):
    rows = queries.op5_packing(spark, sf_dir).collect()
    want = {}
    for i, t in docs:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        want |= {(i, k): min(4096, n - 4096 * k) for k in range(-(-n // 4096))}
    assert {(r.doc_id, r.piece): r.length for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(want.values()) // 4096)
    assert least <= len(bins) <= max(least + 1, math.ceil(least * 1.02))


def test_best_two_fit_exchange():
    assert [b for b, _ in packing.plan_bins({6: 1, 3: 1, 2: 1, 1: 0}, 10)] == [[(6, 1), (3, 1)], [(2, 1)]]
    plan = packing.plan_bins({7: 1, 2: 1, 1: 0}, 10)
    assert sum(n * k * bins for lengths, bins in plan for n, k in lengths) == 9


def repeats(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    return len(inside)


def test_quality(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op6_quality(spark, sf_dir).collect()}
    for i, t in docs:
        t = t or ""
        words, lines = SPACE.findall(t), [x for x in t.split("\n") if SPACE.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats(words))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_is_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] - x[:, 1] + rng.normal(0, 0.4, 2000)) > 0).astype(float)
    forest = quality.fit_forest(x, y, [0, -1, 0])
    grid = np.linspace(0, 1, 200)
    for a, c in rng.random((20, 2)):
        p = forest.margin(np.stack([np.full(200, a), grid, np.full(200, c)], axis=1))
        assert (np.diff(p) <= 1e-12).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.75


def test_topk(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()
    v = {r.vec_id: [math.floor(256 * x) for x in r.embedding] for r in rows}
    want = set()
    for q in (i for i in v if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(v[q], c, strict=True)), i) for i, c in v.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)}
    assert {tuple(r) for r in queries.op7_topk(spark, sf_dir).collect()} == want


def test_topk_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (50, [2.0, 1.0]), (4, []), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df).orderBy("query_id", "rank").collect() if r.query_id == 0]
    assert [g[2] for g in got] == [5, 6, 50, 4]
    assert topk.top_k(df.filter("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_topk_threshold_prunes_and_copies_rank(spark, parts):
    """Frequent equal vectors, ties, signs and uneven lengths; of all pairs of other vectors few are collected."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=int(rng.integers(5, 9)))]) for i in range(400)]
    rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows] + [(50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows]
    want = Counter()
    for at, (q, e) in enumerate(v):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(e, o, strict=False)), i) for j, (i, o) in enumerate(v) if j != at)[:5]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scores))
    assert Counter(tuple(r) for r in topk.top_k(df, parts=parts).collect()) == want
    _, vectors, found = topk.search(df, parts=parts)
    assert found.count() < 0.2 * vectors.filter("asked > 0").count() * vectors.count()


def test_lattice_sums_over_all_segmentations():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    weights = np.log(np.random.default_rng(3).dirichlet(np.ones(model.get_piece_size())))
    lattice = unigram_lm.Lattice(model, weights)
    ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    for word in ("the", "house", "été", "zzq"):
        text = "▁" + word
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts = "".join(c + ("|" if k else "") for c, k in zip(text, [*cuts, 0], strict=True)).split("|")
            if all(p in ids for p in parts):
                total += math.exp(sum(weights[ids[p]] for p in parts))
        assert lattice.log_probability(word) == pytest.approx(math.log(total))
    assert math.isfinite(lattice.log_probability("𝕏퟿"))


def segmentations(text, ids):
    """All ways to cut a text into pieces."""
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in ids:
            for rest in segmentations(text[n:], ids):
                yield [ids[text[:n]], *rest]


def test_expected_counts_of_pieces():
    """A word's count, shared among all its segmentations, with and without logarithms."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    weights = np.log(np.random.default_rng(3).dirichlet(np.ones(model.get_piece_size())))
    ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    for word in ("the", "house", "zzq"):
        found = [*segmentations("▁" + word, ids)]
        p = np.array([math.exp(sum(weights[i] for i in f)) for f in found])
        want = Counter()
        for f, x in zip(found, p / p.sum(), strict=True):
            for i in f:
                want[i] += 7 * x
        for length in (unigram_lm.PLAIN_LENGTH, 0):
            shares = unigram_lm.Shares(model, weights)
            shares.add(word, 7) if length else shares_by_logarithms(shares, word, 7)
            got = {i: c for i, c in enumerate(shares.total) if c > 1e-300}
            assert got == pytest.approx({i: c for i, c in want.items() if c > 1e-300}, rel=1e-6)
    odd = unigram_lm.Shares(model, weights)
    odd.add("a𝕏" * 150, 2)
    assert sum(odd.total[i] for i in odd.byte_ids.values()) == pytest.approx(2 * 150 * len("𝕏".encode()))


def shares_by_logarithms(shares, word, count, monkey=unigram_lm):
    plain = monkey.PLAIN_LENGTH
    monkey.PLAIN_LENGTH = 0
    try:
        shares.add(word, count)
    finally:
        monkey.PLAIN_LENGTH = plain


def test_lm_scores_of_documents(spark):
    """Weights after a round of expectation-maximisation and scores over all segmentations, by brute force."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    texts = ["the cat sat", "The hat the mat", "rats eat", "", None, "a cat ate the oats and tea", "zest"]
    rows = [(i, t) for i, t in enumerate(texts)]
    held = {i: __import__("zlib").crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    words = {i: (t or "").lower().split() for i, t in rows}
    c = Counter(w for i in words if not held[i] for w in words[i])
    ends = sum(not h for h in held.values())

    def weights_of(counts):
        counts[model.eos_id()] += ends
        return np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts)))

    counts = np.zeros(model.get_piece_size())
    for w, n in c.items():
        np.add.at(counts, model.encode(w), n)
    weights = weights_of(counts)
    counts = np.zeros(model.get_piece_size())
    for w, n in c.items():
        found = [*segmentations("▁" + w, ids)]
        p = np.array([math.exp(sum(weights[i] for i in f)) for f in found])
        for f, x in zip(found, p / p.sum(), strict=True):
            np.add.at(counts, f, n * x)
    weights = weights_of(counts)
    want = {i: (sum(math.log(sum(math.exp(sum(weights[x] for x in f)) for f in segmentations("▁" + w, ids))) for w in words[i]) + weights[model.eos_id()]) / math.log(10) for i in words}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.score for r in unigram_lm.lm_scores(df, public_tokenizers.path("piece_bpe_32k.model")).collect()} == pytest.approx(want, rel=1e-6)


def test_lm_base_scores(spark, sf_dir, docs):
    import zlib

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*SPACE.findall((t or "").translate(lower)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(c.values()), len(c)
    rows = queries.op8_unigram_lm(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_passages(spark, sf_dir, docs):
    """Every run of 51 words with an equal run elsewhere lies in a passage, and no other word does."""
    where = defaultdict(list)
    for i, t in docs:
        w = SPACE.findall(t or "")
        for at in range(len(w) - 50):
            where[hash(tuple(w[at : at + 51]))].append((i, at))
    want = defaultdict(set)
    for found in where.values():
        if len(found) > 1:
            for i, at in found:
                want[i] |= set(range(at, at + 51))
    got = defaultdict(set)
    for r in queries.op9_suffix_array(spark, sf_dir).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert got == want


@pytest.mark.parametrize("group", [1, 4])
def test_wide_groups_give_the_same_passages(spark, sf_dir, group):
    """Groups over the bound, and those at the borders of ranges, are compared another way."""
    docs = common.table(spark, sf_dir, "documents")
    docs = docs.union(docs.limit(50)).repartition(7)  # repeated rows too
    rows = lambda n: {(r.doc_id, r.text_hash, str(r.passages)) for r in suffix_array.repeated_passages(docs, group=n).collect()}
    assert rows(group) == rows(suffix_array.GROUP)


def test_frequent_keys_join_alike(spark):
    left = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").filter("k % 2 = 1")
    assert sorted(common.join_hot(left, right, ["k"], "n").collect()) == sorted(left.filter("k % 2 = 1").collect())


def test_a_sieve_loses_no_key(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 10 > 0 THEN id END AS k", "id AS v")
    some, rest = common.sifted(rows, "k", common.sieve(rows.filter("v % 7 = 0"), "k"))
    assert {r.v for r in some.collect()} >= {v for v in range(5000) if v % 7 == 0 or v % 10 == 0}
    assert rest.count() + some.count() == 5000 and some.count() < 1300
    assert common.sifted(rows, "k", common.sieve(rows.filter("false"), "k"))[1].count() == 5000


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1400), 1000)}


def test_cut_repeats(spark):
    p = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"a {p} b"), (2, f"c {p} d"), (3, p), (4, p), (5, "short"), (6, None)], "doc_id long, text string")
    assert [r.text for r in suffix_array.cut_repeats(df).orderBy("doc_id").collect()] == [f"a {p} b", "c  d", "", "", "short", None]


def test_bpe(spark, sf_dir, docs, tokenizer):
    got = {r.doc_id: r for r in queries.op10_bpe(spark, sf_dir).collect()}
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_odd_texts(odd, tokenizer):
    rows = odd.select("text", bpe_trie.bpe_ids("text", public_tokenizers.path("word_bpe_49k.json")).alias("ids")).collect()
    assert [r.ids for r in rows] == [tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in rows]


def test_odd_documents(spark, odd):
    n = odd.count()
    assert pii.redact(odd).count() == n and pii.redact(odd).columns == odd.columns
    assert sharding.shard(odd.drop("shard"), 8).count() == n
    near = ngram_join.near_duplicates(odd)
    assert near.count() == n
    one = ngram_join.one_of_each(odd)
    assert one.columns == odd.columns and one.count() == 4
    assert packing.pack(packing.token_pieces(odd, public_tokenizers.path("word_bpe_49k.json"))).select("doc_id").count() >= n
    judged = quality.judge(odd.drop("kept"), None)
    assert judged.count() == n and judged.filter("text IS NULL AND kept").count() == 0
    assert unigram_lm.lm_scores(odd, public_tokenizers.path("piece_bpe_32k.model")).count() == n
    assert suffix_array.cut_repeats(odd).count() == n


def test_result_names_are_refused_not_overwritten(odd):
    with pytest.raises(ValueError, match="shard"):
        sharding.shard(odd, 8)
    with pytest.raises(ValueError, match="kept"):
        quality.judge(odd, None)


def test_empty_documents(spark, odd):
    none = odd.filter("false")
    assert ngram_join.near_duplicates(none).count() == 0
    assert packing.pack(packing.token_pieces(none, public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert unigram_lm.lm_scores(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert suffix_array.passage_rows(none).count() == 0
    assert sharding.shard(none.drop("shard"), 8).count() == 0


def test_pii_query_by_brute_force(spark, sf_dir, odd, docs):
    """Counts of the base kinds and all spans; null, empty and long texts, repeated rows, no rows."""
    known = dict(docs)
    for r in queries.op1_pii(spark, sf_dir).collect():
        base = spans(known[r.doc_id]).split(",")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(f"{k}:") for s in base) for k in ("email", "ip", "card", "phone"))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in pii.find(known[r.doc_id]))
    rows = odd.select("text", pii.pii_spans("text").alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in rows] == [pii.find(r.text) for r in rows]
    assert odd.filter("false").select(pii.pii_spans("text")).count() == 0 and pii.redact(odd.filter("false")).count() == 0


def test_pieces_of_another_key(spark):
    df = spark.createDataFrame([("b", "some words here"), ("a", None)], "name string, body string")
    got = packing.pack(packing.token_pieces(df, public_tokenizers.path("word_bpe_49k.json"), 8, key="name", text="body"), 8)
    assert got.columns == ["name", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and {r.name for r in got.collect()} == {"a", "b"}


def test_pipeline_stages_on_odd_and_empty_documents(spark, sf_dir, odd):
    """Each stage on nulls, empty, long and equal texts, repeated rows and clashing names keeps the columns; texts are as by plain code."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("__row"), F.lit("k").alias("key"))
    stages = dict(corpus_pipeline.STAGES)
    plain = {"personal_data": lambda t: pii.redacted(t, pii.find(t))}
    for name, stage in stages.items():
        for rows in (docs, docs.filter("false")):
            got = stage(spark, rows, sf_dir)
            if name != "packed":
                assert got.columns == docs.columns
            out = got.collect()
            assert len(out) == 0 if rows is not docs else len(out) > 0 or name == "quality_rules"
            if name in plain and rows is docs:
                assert sorted(r.text for r in out if r.text is not None) == sorted(plain[name](r.text) for r in docs.collect() if r.text is not None)


def test_pipeline(spark, sf_dir):
    """Each stage on all that the one before kept, held against the operators' own results."""
    docs = common.table(spark, sf_dir, "documents")
    kept = {r.doc_id for r in queries.op6_quality(spark, sf_dir).filter("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, sf_dir)
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    single = stages["near_duplicates"](spark, good, sf_dir)
    assert single.columns == docs.columns
    groups = {r.class_id for r in ngram_join.near_duplicates(good).collect()}
    assert {r.doc_id for r in single.collect()} == groups
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "sequence_id", F.col("length")).collect()
    assert {r.doc_id for r in rows} == groups
