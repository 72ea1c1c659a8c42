"""The corpus pipeline against its stages in plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.fixtures import documents, empty, rows
from tests.llm.test_models import simhash_slow, union
from tests.llm.test_native import WORD, secrets_of, water
from vectrail.llm import packing


def test_stages_keep_columns_and_whole_results(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    by_name = dict(corpus_pipeline.STAGES)
    assert len(by_name) == 5
    # language: every text with a letter stays
    named = by_name["language_id"](spark, docs, sf_dir)
    kept = named.collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    # near-duplicates: the smallest id of each group
    fps = [simhash_slow(r["text"]) for r in kept]
    roots = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for r, root in zip(kept, roots, strict=True):
        least[root] = min(r["doc_id"], least.get(root, r["doc_id"]))
    single = by_name["near_dedup"](spark, named, sf_dir)
    assert {r["doc_id"] for r in single.collect()} == set(least.values()) and single.count() == len(least)
    # secrets: gone, all rows there
    clean = by_name["secret_scan"](spark, single, sf_dir)
    rows = clean.collect()
    assert {r["doc_id"] for r in rows} == set(least.values()) and not any(secrets_of(r["text"]) for r in rows)
    # mixture: words of each source near the target
    sizes, got = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))})
    mixed = by_name["mixing"](spark, clean, sf_dir)
    for r in mixed.collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(got[s] - want[s]) <= 0.5 + 1e-9 for s in sizes)
    # packing: every id once
    pieces = by_name["packing"](spark, mixed, sf_dir)
    tokens = packing.ByteTokenizer(packing.default_tokenizer())
    total = defaultdict(int)
    for r in mixed.collect():
        total[r["doc_id"]] += len(tokens.encode(r["text"])) // 4 + 1
    packed = defaultdict(int)
    for r in pieces.collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == total
    for stage in (named, single, clean, mixed):
        assert stage.columns == docs.columns


def test_run_equals_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_on_odd_rows_and_none(spark, sf_dir):
    names = ["doc_id", "text", "lang", "source", "n_chars", "score"]
    docs, found = documents(spark).select(names), rows()
    stages = dict(corpus_pipeline.STAGES)
    # of null texts and texts without a letter none stays; of equal rows and of linked texts one
    named = stages["language_id"](spark, docs, sf_dir)
    lettered = [(i, t) for i, t, *_ in found if any(c.isalpha() for c in t or "")]
    kept = Counter((r["doc_id"], r["text"]) for r in named.collect())
    assert named.columns == names and not kept - Counter(lettered) and None not in {t for _, t in kept}
    single = stages["near_dedup"](spark, docs, sf_dir)
    fps = [simhash_slow(t) for _, t, *_ in found]
    roots = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert single.columns == names and single.count() == len(set(roots))
    clean = stages["secret_scan"](spark, docs, sf_dir)
    assert clean.columns == names and clean.count() == len(found)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, *_ in found)
    mixed = stages["mixing"](spark, docs, sf_dir)
    assert mixed.columns == names and not {r["doc_id"] for r in mixed.collect()} & {100, 101, 102}
    assert {r["doc_id"] for r in stages["packing"](spark, docs, sf_dir).collect()} == {i for i, *_ in found}
    nothing = empty(spark).select(names)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0, name
