import math
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixtally.llm import decontamination, neardup, packing, passages, quality, suffixes, tokens, toxicity, urls, warc

DOCS = "doc_id long, text string, source string, id long, tid string, code int, key string, n long"


def prose(rng, n, size=4000):
    return " ".join(f"w{x}" + rng.choice(["", ".", ",", "\n"], p=[0.8, 0.08, 0.08, 0.04]) for x in (rng.zipf(1.3, n) % size))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = [prose(rng, int(n)) for n in rng.integers(1, 400, 40)] + [prose(rng, 6000)]
    out = dict(enumerate(base))
    words = base[40].split(" ")
    out[41], out[42], out[43], out[44] = None, "", " \n\t", "x"
    out[45] = base[3]  # an exact copy
    for k in range(46, 60):  # near copies of one text, each with edits of its own
        w = words[:300]
        for i in rng.integers(0, 300, int(rng.integers(0, 6))):
            w[i] = f"edit{k}{i}"
        out[k] = " ".join(w)
    passage = " ".join(words[1000:1070])
    for k in range(60, 70):
        out[k] = f"{prose(rng, 90)} {passage} {prose(rng, int(rng.integers(0, 90)))}"
    out[70] = " ".join(["same"] * 400)
    out[71] = "ab " * 300 + "".join(chr(0xE9) for _ in range(150)) * 2
    out[72] = "EXTRA <|endoftext|> don't \u0130stanbul \u03a3\u03a3 e\u0301 \x1c 12 \x85 it's  two  spaces\n\n\n"
    out[73] = passage.upper()
    out[74] = prose(rng, 3000) + " " + passage
    out[75] = f"{prose(rng, 40000)} {passage} {out[5]} {prose(rng, 500)}"  # longer than a step
    tm = "".join("ab"[i.bit_count() & 1] for i in range(1024))  # such texts and their complements collide in sums modulo 2 ** 64
    out[76], out[77] = tm, tm.translate({97: 98, 98: 97})
    out[78], out[79] = " ".join(out[76]), " ".join(out[77])
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "s", -d, "x", 1, "k", 2) for d, t in rows.items()], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_rows_without_an_id_repeated_and_clashing(spark, empty):
    """What each operator makes of null ids, repeated rows and ids of several texts; columns of docs have clashing names."""
    rng = np.random.default_rng(9)
    one, two = prose(rng, 120), prose(rng, 120)
    shared = " ".join(one.split()[:80])
    rows = [(None, one), (None, None), (3, one), (3, one), (3, two), (4, f"{shared} tail"), (5, "")]
    names = ["n_words", "kept_text", "kept", "spans", "hits", "row", "phrases", "bytes", "n"]
    odd = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    items = spark.createDataFrame([(None, shared), (1, None), (2, "")], "item_id long, text string")
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    got = lambda df, *cols: sorted(key(tuple(r[c] for c in ("doc_id", *cols))) for r in df.collect())
    n = len(one.split())
    assert got(passages.remove_passages(odd), "n_words", "n_removed") == sorted([(-1, 0, 0), (-1, n, 0), (3, n, n), (3, n, n), (3, n, 0), (4, 81, 80), (5, 0, 0)])
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.remove_substrings(odd).collect()}
    assert cut[None, len(one.encode())] == 0 and cut[3, len(one.encode())] == len(one.encode()) and cut[3, len(two.encode())] == 0
    near = [key((r.doc_id, r.component_id, r.kept)) for r in neardup.near_duplicates(odd).collect()]
    assert sorted(near, key=str) == sorted([(-1, None, True), (-1, None, True), (3, None, False), (3, None, False), (3, 3, True), (4, 4, True), (5, 5, True)], key=str)
    assert got(decontamination.contamination(odd, items), "contaminated", "n_items") == sorted([(-1, False, 0), (-1, True, 1), (3, False, 0), (3, True, 1), (3, True, 1), (4, True, 1), (5, False, 0)])
    counts = got(tokens.token_counts(odd), "n_bytes")
    assert counts == sorted((-1 if i is None else i, len((t or "").encode())) for i, t in rows)
    assert got(quality.judge(odd), "n_words", "base_failed") == sorted((-1 if i is None else i, len((t or "").split()), brute.base_rules(t)[5]) for i, t in rows)
    packed = got(packing.pack(packing.pieces_of(odd)), "piece", "start")
    assert packed == sorted((-1 if i is None else i, 0, 0) for i, _ in rows)
    graded = toxicity.grade(odd, toxicity.train(odd, spark.createDataFrame([(3, 0), (3, 1), (None, 1)], "doc_id long, toxic int")))
    assert len(got(graded, "toxic")) == len(rows)
    ops = [neardup.near_duplicates, suffixes.remove_substrings, passages.remove_passages, tokens.token_counts, quality.judge, lambda d: decontamination.contamination(d, items), lambda d: decontamination.contamination(odd, items.limit(0)).where("contaminated"), lambda d: toxicity.grade(d, toxicity.Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(3))), lambda d: packing.pack(packing.pieces_of(d))]
    for op in ops:
        assert op(empty).count() == 0


def test_packing(spark, docs, rows):
    got = packing.pack(packing.pieces_of(docs)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(rows)
    for d, t in rows.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in parts] == [(k, s, len(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    fit, least = brute.best_fit_bins([r.length for r in got])
    assert least <= len(by_seq) <= fit + 1


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 1500, 300))[::-1].copy()
    a, b = packing.first_of(lengths, None, 2048), packing.first_of(lengths, rng, 2048)
    for _ in range(30):
        c = packing.cross(a, b, lengths, rng, 2048)
        assert len(c) == 300 and np.bincount(c, lengths).max() <= 2048 and np.bincount(c).min() > 0
    best = packing.evolve(lengths, [], 2, 10, 4, 2048)[0]
    assert best.max() <= a.max()


def test_urls(spark):
    hosts, paths = ["com", "example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "x.net", "net", "notexample.com", "spam-farm.example.org", "m.spam-farm.example.org", "", "com:80", "b..net"], ["", "/", "/en/", "/en", "/en/1?x=/fr/", "/fr/1", "/es/#a", "?q=/en/", "/EN/"]
    all_ = [None, "", "nothing", "://", "http:/x"] + [f"http://{h}{p}" for h in hosts for p in paths] + ["a://b://com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(all_)] + [(None, "http://x.com/", None)], "page_id long, url string, host string")

    def plain(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.translate(brute.LOW)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fits:
            best = max(fits, key=lambda r: len(r.key))
            return host, path, best.key, best.action
        return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in urls.LISTED_HOSTS) else "allow"

    for r in urls.judge(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url)
    assert urls.judge(pages.limit(0)).count() == 0
    hosts_ = spark.createDataFrame([("x.net",), (None,), ("spam.org",)], "name string")
    far = spark.createDataFrame([(1, "http://" + "a." * 40000 + "net/es/" + "x" * 200000), (2, "http://m.x.net/"), (3, "https://y.x.net.org"), (4, "http://spam.org")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(far, listed=hosts_).collect()} == {1: ("net/es/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "block")}


def test_cascades(spark, monkeypatch):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(4000)], "key string")
    listed = keys.where(F.substring("key", 2, 9).cast("int") % 7 == 0)
    made = urls.build(keys, {"some": listed, "none": listed.limit(0), "all": keys}, rate=0.3)
    h = urls.hashed(keys).toArrow()
    a, b = h["a"].to_numpy(), h["b"].to_numpy()
    assert len(made["some"].bits) > 2 and (made["some"].holds(a, b) == (np.arange(4000) % 7 == 0)).all()
    assert not made["none"].holds(a, b).any() and made["all"].holds(a, b).all()
    monkeypatch.setattr(urls, "MAX_WRONG", 10)  # the rate is lowered until few enough pass
    few = urls.build(keys, {"few": listed.limit(20)}, rate=0.3)["few"]
    assert few.holds(a, b).sum() == 20
    monkeypatch.setattr(urls, "MAX_KEYS", 100)
    with pytest.raises(ValueError, match="more than 100 keys"):
        urls.build(keys, {"many": listed})


def test_quality(spark, docs, rows):
    for r in quality.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_rules(rows[r.doc_id])
        assert not (r.base_failed and r.kept)
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"{''.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(120)) + ".\nMore.") for i in range(200)]
    junk = [(1000 + i, " ".join(f"{''.join(rng.choice(list('abcdefgh'), 5))}$$$" for _ in range(120))) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(texts + junk, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in texts) and not any(got[i] for i, _ in junk)


def votes_of(rng, n, junk, noise=None):
    """Votes of six rules on good documents and, with share junk, on ones that rules 0 and 5 or rules 1 and 4 find bad."""
    kind = rng.choice(3, n, p=[1 - junk, junk / 2, junk / 2])
    votes = np.where(rng.random((n, 6)) < 0.03, 1, 2)
    for k, pair in ((1, (0, 5)), (2, (1, 4))):
        for r in pair:
            votes[(kind == k) & (rng.random(n) < 0.9), r] = 0
    if noise is not None:
        votes[:, 3] = np.where(rng.random(n) < noise, 0, 2)
    return kind, votes


def counted(votes):
    patterns, n = np.unique(votes @ 3 ** np.arange(6), return_counts=True)
    return dict(zip(patterns.tolist(), n.tolist(), strict=True))


def test_expectation_maximisation_matches_one_over_documents():
    _, votes = votes_of(np.random.default_rng(2), 400, 0.2, 0.1)
    kinds = (0, 1, 3)
    got, fit = quality.expectation_maximisation(counted(votes), 6, kinds, rounds=20)
    start = np.array([[quality.ON_GOOD] * 6] + [[quality.OWN if k == r else quality.ON_OTHERS for r in range(6)] for k in kinds])
    rates, prior, held = start.copy(), np.array([quality.GOOD_SHARE] + [(1 - quality.GOOD_SHARE) / 3] * 3), quality.TRUST * len(votes)
    for step in range(20):
        joint = prior * np.array([[math.prod(rates[k, r, v] for r, v in enumerate(d)) for k in range(4)] for d in votes])
        post = joint / joint.sum(1, keepdims=True)
        if step < 19:
            prior = (post.sum(0) + 1) / (len(votes) + 4)
            for k in range(4):
                for r in range(6):
                    for x in range(3):
                        rates[k, r, x] = (post[votes[:, r] == x, k].sum() + held * start[k, r, x]) / (post[:, k].sum() + held)
    assert fit == pytest.approx(np.log(joint.sum(1)).sum())
    assert all(got[p] == pytest.approx(x, abs=1e-9) for p, x in zip((votes @ 3 ** np.arange(6)).tolist(), post[:, 0], strict=True))


@pytest.mark.parametrize("noise", [0.02, 0.2, 0.3, 0.5, 0.8, 0.97])
def test_a_rule_that_votes_at_random_rejects_nothing(noise):
    kind, votes = votes_of(np.random.default_rng(4), 3000, 0.1, noise)
    post, kinds = quality.posterior(counted(votes), 6)
    p = np.array([post[x] for x in (votes @ 3 ** np.arange(6)).tolist()])
    alone = (votes[:, 3] == 0) & ((votes == 0).sum(1) == 1)
    assert 3 not in kinds and (p[alone & (kind == 0)] >= quality.KEEP).all()
    both = ((votes[:, 0] == 0) & (votes[:, 5] == 0)) | ((votes[:, 1] == 0) & (votes[:, 4] == 0))
    assert (p[both] < quality.KEEP).all() and (p[kind == 0] >= quality.KEEP).mean() > 0.999


def test_near_duplicates(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute.near(list(rows.items()))


def test_stars_hide_no_link(spark):
    """Copies near one text but not near each other, whose ids come before it."""
    rng = np.random.default_rng(8)
    words = [f"v{x}" for x in rng.integers(0, 10**6, 300)]
    made = []
    for k in range(60):
        w = list(words)
        for i in rng.choice(300, 8, replace=False):
            w[i] = f"e{k}x{i}"
        made.append((k, " ".join(w)))
    made.append((100, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == brute.near(made)


def test_token_counts(docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    for r in tokens.token_counts(docs).collect():
        t = rows[r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    for _ in range(300):
        s = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 100)))
        assert suffixes.difference_cover(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_substrings(docs, rows, monkeypatch):
    want = brute.suffixes(list(rows.items()))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_substrings(docs).collect()} == want


def test_passages(docs, rows):
    want = brute.passages(list(rows.items()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in passages.remove_passages(docs).collect()}
    assert got == {d: (n, gone, brute.sha(kept), kept if gone else rows[d] or "") for d, (n, gone, kept) in want.items()}
    assert sum(gone > 0 for _, gone, _ in want.values()) > 10


def test_occurrences_come_from_the_automata_alone(rows, monkeypatch):
    texts = [rows[60], rows[61], rows[75]]
    table = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "tid": [0, 0, 0], "text": texts})
    found = pa.Table.from_batches(passages.anchor_batches(True)(iter([table]))).to_pylist()
    words = {r["code"]: r["words"] for r in found if {x["id"] for x in found if x["code"] == r["code"]} > {r["id"]}}
    phrases = [[{"code": c, "words": w} for c, w in words.items()]] * 3
    batch = pa.RecordBatch.from_arrays([*table.columns, pa.array(phrases, pa.list_(pa.struct([("code", pa.int64()), ("words", pa.binary())])))], [*table.schema.names, "phrases"])
    locate = lambda: sorted((r["id"], r["lo"]) for b in passages.locate_batches(iter([batch])) for r in b.to_pylist())
    got = locate()
    assert {i for i, _ in got} == {1, 2, 3}
    monkeypatch.setattr(passages, "PATTERNS", 3)  # the same through many automata
    assert sorted(set(locate())) == got
    fewer = dict(list(words.items())[::2])
    monkeypatch.setattr(passages, "automaton_of", lambda ps, f=passages.automaton_of: f({c: w for c, w in ps.items() if c in fewer}))
    assert 0 < len(set(locate())) < len(got)


def test_decontamination(spark, docs, rows):
    items = [(1, rows[5]), (2, "w1 W2"), (3, None), (10, rows[60]), (7, "x"), (8, "edit"), (9, rows[72]), (11, rows[76]), (12, rows[79])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n long")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(docs, bench).collect()}
    assert got == brute.leaks(list(rows.items()), items)


def test_toxicity(spark):
    rng = np.random.default_rng(7)
    bad, made, marks = ["grumble", "snarl", "grumbles", "hiss", "growl", "bite"], [], []
    for i in range(900):
        w = [f"w{x}" for x in rng.integers(0, 300, 60)]
        n = int(rng.integers(1, 6)) if i % 6 == 0 else 0
        for k in range(n):
            w[10 * k] = str(rng.choice(bad))
        made.append((i, " ".join(w)))
        marks.append((i, int(n > 0)))
    long = " ".join(f"w{x}" for x in rng.integers(0, 300, 40000))
    docs = spark.createDataFrame([*made, (900, None), (901, ""), (902, f"{long} snarl hiss growl bite"), (903, long), (5, made[5][1]), (None, "snarl hiss growl bite grumble")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks[:600], (None, 1), (5000, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0.1).all()
    rows = toxicity.grade(docs.withColumn("toxic", F.lit("x")).withColumn("grade", F.lit(9)), model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 906 and {r.grade for r in rows} == {0, 1, 2, 3}
    assert np.mean([got[i].toxic == bool(t) for i, t in marks[600:]]) > 0.97
    assert not got[900].toxic and got[900].severity == got[901].severity
    assert got[902].toxic and not got[903].toxic and got[None].grade == 3
    assert toxicity.grade(docs, toxicity.train(docs, labels.limit(0))).where("toxic").count() == 0
    assert toxicity.grade(docs, toxicity.train(docs.limit(0), labels)).where("toxic").count() == 0
    graded = toxicity.train(docs, spark.createDataFrame([(i, t * (i % 3 + 1)) for i, t in marks], "doc_id long, toxic int"), graded=True)
    assert len(graded.thresholds) == 3


def test_likelihood_of_grades():
    """The objective is the plain likelihood of a cumulative-link model, and its gradient that of small steps."""
    rng = np.random.default_rng(12)
    x, y, p = (rng.random((50, 4)) < 0.4) * 1.0, rng.integers(0, 4, 50), rng.normal(size=7) * 0.5

    def plain(p):
        t = [p[4], p[4] + math.exp(p[5]), p[4] + math.exp(p[5]) + math.exp(p[6])]
        below = lambda k, score: 0.0 if k < 0 else 1.0 if k > 2 else 1 / (1 + math.exp(score - t[k]))
        fit = sum(math.log(below(g, r @ p[:4]) - below(g - 1, r @ p[:4])) for r, g in zip(x, y.tolist(), strict=True))
        return -fit / len(y) + toxicity.PENALTY / 2 * sum(w * w for w in p[:4])

    value, gradient = toxicity.objective(p, x, y)
    assert value == pytest.approx(plain(p))
    for k, step in enumerate(np.eye(7) * 1e-6):
        assert gradient[k] == pytest.approx((plain(p + step) - plain(p - step)) / 2e-6, abs=1e-6)
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), np.array([-1.0, 0.5, 2.0]))
    assert model.chances(np.array([0.3])).sum() == pytest.approx(1)


def test_fixity(spark):
    names = [(i, f"http://h/{i}", "x" * (i % 50) * 40) for i in range(700)] + [(None, None, None), (7, "http://h/7", "again"), (7, "http://h/7", "again"), (650, "long", "y" * 200000)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in names], "page_id long, url string, html string, file int, record string")
    recs = warc.settle(warc.records(pages, per_file=300))
    states = lambda a, b: {s: n for s, n in warc.fixity(a, b).groupBy("state").count().collect()}
    assert states(recs, recs) == {"sound": 704}
    hurt = recs.withColumn("record", F.when(F.col("page_id") == 123, F.concat("record", F.lit("!"))).otherwise(F.col("record")))
    assert {r.page_id for r in warc.fixity(recs, hurt).where("state = 'corrupt'").collect()} == {123}
    less = recs.where("page_id <> 10 OR page_id IS NULL")  # lost in the middle of a file
    assert states(recs, less) == {"sound": 703, "missing": 1} and states(less, recs) == {"sound": 703, "extra": 1}
    twice = recs.union(recs.where("page_id = 20"))  # a record that one replica holds twice
    assert states(recs, twice) == {"sound": 704, "extra": 1} and states(twice, twice) == {"sound": 705}
    assert states(recs, recs.limit(0)) == {"missing": 704} and states(recs.limit(0), recs.limit(0)) == {}
    node = warc.audit(warc.leaves(recs), warc.leaves(less)).collect()
    at = recs.where("page_id = 10").first()
    own = warc.leaves(recs).where("page_id = 10").first()
    assert {(r.file, r.node) for r in node} <= {(own.file, own.node), *((r.file, r.node) for r in warc.leaves(less).where("file = 0 AND page_id < 10").collect())}
    assert len(node) <= 2 and at.file == own.file
    for file in (0, 1, 2):
        rs = recs.where(F.col("file") == file).orderBy("offset").collect()
        at = 0
        for r in rs:
            assert r.offset == at and r.length == len(r.record.encode())
            at += r.length
    assert warc.records(pages.limit(0)).count() == 0


def test_warc_files_and_hot_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"WARC/1.0\r\n{i}\r\n\r\n" * (i % 3)) for i in range(50)] + [(None, "v", "same")] * 300, "page_id long, url string, html string")
    recs = warc.settle(warc.records(pages, per_file=20))
    parts = {(r.file, r.part): r["count"] for r in recs.groupBy("file", "part").count().collect()}
    assert len([k for k in parts if k[0] == -1]) == 4 and max(n for (f, _), n in parts.items() if f == -1) < 150
    assert recs.exceptAll(warc.records(pages.repartition(7), per_file=20)).isEmpty()  # parts don't depend on the partitioning
    warc.write_warc(recs, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert back.count() == 350 and recs.exceptAll(back).isEmpty() and back.exceptAll(recs).isEmpty()


@pytest.mark.parametrize("lost", [10, 96])
def test_a_lost_record_of_a_file(spark, tmp_path, lost):
    """A replica that is read from files moves all offsets behind a loss; one record is missing all the same."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i % 50) * 40) for i in range(250)], "page_id long, url string, html string")
    recs = warc.settle(warc.records(pages))
    warc.write_warc(recs.where(F.col("page_id") != lost), str(tmp_path / "w"))
    found = warc.fixity(recs, warc.read_warc(spark, str(tmp_path / "w")))
    assert {r.state: r["count"] for r in found.groupBy("state").count().collect()} == {"sound": 249, "missing": 1}
    assert found.where("state = 'missing'").first().page_id == lost


def test_warc_of_others(spark, tmp_path):
    """A warcinfo record takes its place, responses come out, in one gzip member or many; each record can be sought."""
    import gzip

    record = lambda kind, body, id_: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <{id_}>\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()
    some = [record("warcinfo", "software: x\r\n", "urn:uuid:1"), record("response", "HTTP/1.1 200 OK\r\n\r\né", "urn:uuid:2"), record("resource", "", "urn:page:7")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, some)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(some)))
    (tmp_path / "c.warc").write_bytes(b"".join(some))
    got = sorted((r.offset, r.length, r.page_id) for r in warc.read_warc(spark, str(tmp_path)).collect())
    a, b, c = map(len, some)
    assert got == sorted([(a, b, None), (a + b, c, 7)] * 3, key=str) or got == sorted([(a, b, None)] * 3 + [(a + b, c, 7)] * 3, key=lambda r: (r[0], r[1]))
    pages = spark.createDataFrame([(i, "u", "y" * i) for i in range(5)], "page_id long, url string, html string")
    warc.write_warc(warc.records(pages), str(tmp_path / "w"))
    data = (tmp_path / "w" / "file=0" / "part=0" / "records.warc.gz").read_bytes()
    starts = [k for k in range(len(data)) if data.startswith(b"\x1f\x8b\x08", k)]
    assert len(starts) == 5 and gzip.decompress(data[starts[3] :]).startswith(b"WARC/1.0") and b"<urn:page:3>" in gzip.decompress(data[starts[3] :])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(some[0] + b"junk")
    with pytest.raises(Exception, match="no WARC record at byte"):
        warc.read_warc(spark, str(tmp_path / "bad")).collect()


def test_long_lists_are_joined(spark, monkeypatch):
    """A list over the bound decides as its cascade does."""
    pages = spark.createDataFrame([(i, f"http://{h}/en/{i}?q") for i, h in enumerate(["a.x.org", "x.org", "y.org", "b.z.net", "z.net"] * 3)] + [(99, None)], "page_id long, url string")
    listed = urls.settle(urls.tracked_hosts(pages, least=3))
    assert listed.count() == 5
    some = spark.createDataFrame([("x.org",), ("b.z.net",), ("q.org",)], "host string")
    want = sorted(map(str, urls.judge(pages, listed=some).collect()))
    monkeypatch.setattr(urls, "MAX_KEYS", 2)
    monkeypatch.setattr(urls, "RULES", urls.RULES[:1])
    rules = urls.RULES
    assert sorted(map(str, urls.judge(pages, rules=rules, listed=some).collect())) == sorted(map(str, urls.judge(pages, rules=rules, listed=("x.org", "b.z.net")).collect()))
    assert sum("'block'" in w for w in want) == 9
