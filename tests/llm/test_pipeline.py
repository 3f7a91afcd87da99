import zlib
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from helixtally.llm import earliest, neardup, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = lambda n: " ".join(f"{''.join(rng.choice(list('abcdefghijkl'), 5))}" for _ in range(n)) + ".\nEnd."
    rows = {i: words(int(rng.integers(60, 200))) for i in range(40)}
    rows[40], rows[41], rows[42] = rows[1], rows[2] + " tail", None
    passage = " ".join(words(80).split()[:70])
    for i in range(43, 48):
        rows[i] = f"{words(80)} {passage} {words(60)}"
    item = words(30)
    rows[48] = f"{words(90)} {item} {words(60)}"
    rows[49], rows[None] = "short text", words(100)
    rows[50] = " ".join(["again and again"] * 60)
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows.items()], SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_run_matches_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.text for r in quality.judge(docs).where("kept").collect()}
    assert set(kept) == {r.doc_id for r in docs.collect()} - {42, 49, 50}
    kept = {-1 if d is None else d: t for d, t in kept.items()}  # a null id counts as the smallest
    near = brute.near(list(kept.items()))
    kept = {d: t for d, t in kept.items() if near[d][1] == d}
    cut = brute.passages(list(kept.items()))
    kept = {d: (cut[d][2] if cut[d][1] else t) for d, t in kept.items() if cut[d][0] > cut[d][1]}
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    hit = brute.leaks(list(kept.items()), [(item.item_id, item.text)])
    kept = {d: t for d, t in kept.items() if not hit[d][4]}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert not {40, 41, 48} & set(kept) and cut[44][1] > 0 and cut[43][1] == 0
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = set()
    for d, t in kept.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    assert {(-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    loads: dict = {}
    for r in got:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert max(loads.values()) <= 2048


def test_columns_of_any_name_and_repeated_rows(spark, sf_dir):
    """Each stage keeps the values of columns that are named like its own, and a repeated row's number, but for near-dedup."""
    names = ["kept", "n_words", "kept_text", "cut_id", "bad_id", "row", "id", "tid", "spans", "hits", "n", "pattern", "component", "n_hit", "items", "p_good"]
    rng = np.random.default_rng(14)
    words = lambda n: " ".join(f"{''.join(rng.choice(list('abcdefghijkl'), 5))}" for _ in range(n)) + ".\nEnd."
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    passage = " ".join(words(70).split()[:60])
    same, first, later, leak = words(120), f"{words(80)} {passage} {words(60)}", f"{words(80)} {passage} {words(60)}", f"{words(90)} {item} {words(60)}"
    texts = [(1, same), (1, same), (1, same), (2, first), (None, later), (3, later), (4, leak), (None, None)]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{n}-{k}" for n in names]) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, " + ", ".join(f"{n} string" for n in names))
    extra = lambda df: sorted(tuple(r)[5:] for r in df.collect())
    for (_, stage), gone in zip(corpus_pipeline.STAGES[:-1], ({7}, {1, 2, 5}, {5, 7}, {6}), strict=True):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = extra(out)
        if stage is corpus_pipeline.near_dedup:  # one of the three equal rows, and of the two equal texts that of the null id
            assert sorted(x[0] for x in got if x[0] not in ("kept-0", "kept-1", "kept-2")) == ["kept-3", "kept-4", "kept-6", "kept-7"] and len(got) == 5
        else:
            assert got == sorted(r[5:] for k, r in enumerate(rows) if k not in gone)
    cut = {r.kept: r for r in corpus_pipeline.passage_dedup(spark, docs, sf_dir).collect()}
    assert cut["kept-4"].text == later and passage not in cut["kept-3"].text
    assert cut["kept-3"].n_chars == len(cut["kept-3"].text) < len(first)
    assert corpus_pipeline.pack(spark, docs, sf_dir).count() == 8


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


def test_rows_without_an_id_or_that_share_one_are_judged_by_themselves(spark, sf_dir, tmp_path):
    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"{''.join(rng.choice(list('abcdefghijkl'), 5))}" for _ in range(n)) + ".\nEnd."
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    a, b, c, d, e = (words(120) for _ in range(5))
    leak = f"{words(90)} {item} {words(60)}"
    rows = [(None, a), (None, b), (None, leak), (7, c), (7, d), (7, d), (8, a + " tail"), (9, b + " tail"), (10, e), (7, e + " tail")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)
    near = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    want = sorted([a, b, leak, c, d, e + " tail"])
    assert sorted(r.text for r in near.collect()) == want
    cut = corpus_pipeline.passage_dedup(spark, docs.where("doc_id IS NULL OR doc_id = 7"), sf_dir)
    assert sorted((r.doc_id or -1, r.text) for r in cut.collect()) == sorted((i or -1, t) for i, t in rows if i in (None, 7))
    clean = corpus_pipeline.decontaminate(spark, docs, sf_dir)
    assert sorted(r.text for r in clean.collect()) == sorted(t for _, t in rows if t != leak)
    for k in range(2):  # through files, as the stages run
        near.write.parquet(str(tmp_path / f"{k}"))
        near = (corpus_pipeline.passage_dedup, corpus_pipeline.decontaminate)[k](spark, spark.read.parquet(str(tmp_path / f"{k}")), sf_dir)
    assert sorted(r.text for r in near.collect()) == sorted(set(want) - {leak})


def test_components_keep_nodes_of_one_id_apart(spark):
    """Documents near two unrelated rows without an id are two groups."""
    rng = np.random.default_rng(13)
    x, y = (" ".join(f"v{w}" for w in rng.integers(0, 10**6, 200)) for _ in range(2))
    rows = [(None, x), (None, y), (1, x + " one"), (2, y + " two"), (3, x + " three")]
    got = neardup.groups(earliest.keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r.component.id, r.component.tid), set()).add(r.id)
    assert sorted(map(sorted, by.values())) == [[earliest.NULL_ID, 1, 3], [earliest.NULL_ID, 2]]
