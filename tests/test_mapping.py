"""Mapping operators against plain Python."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions import records
from vectrail.functions import text as X
from vectrail.operators import backends, jobs, mapping
from vectrail.plans import mapping_queries as Q
from vectrail.session import table
from vectrail.sources import readers


def plain_spans(text, most, overlap):
    paras, at = [], 0
    for m in [*re.finditer(r"(?:\r?\n[ \t]*){2,}", text), None]:
        piece = text[at : m.start() if m else len(text)]
        lead = len(piece) - len(piece.lstrip())
        if piece.strip():
            paras.append((at + lead, at + lead + len(piece.strip())))
        at = m.end() if m else at
    out = []
    for a, b in paras:
        if b - a > most:
            out += [["long", x, min(x + most, b)] for x in range(a, b, most)]
        elif out and out[-1][0] == "open" and b - out[-1][1] <= most:
            out[-1][2] = b
        else:
            out.append(["open", a, b])
    found = [(a, b) for _, a, b in out]
    return [(max(0, a - overlap) if i else a, b) for i, (a, b) in enumerate(found)] or [(0, min(len(text), most))]


def test_report_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text", "doc_id").collect()
    texts = [r["text"].replace("\n", "\n\n") for r in docs]
    texts += ["", "  \n\n ", "a\n\n" + "b" * 50, "x" * 2500 + "\r\n \r\n tail ", "\n\n one \n \t\n two\n\n\n\nthree " * 400, "p\n\n" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for most, overlap in ((1200, 100), (40, 0)):
        got = {r["i"]: [tuple(x) for x in r["s"]] for r in df.select("i", mapping.report_spans(F.col("t"), most, overlap).alias("s")).collect()}
        assert got == {i: plain_spans(t, most, overlap) for i, t in enumerate(texts)}
    assert spark.range(1).select(mapping.report_spans(F.lit(None).cast("string"), 5).alias("s")).first()["s"] is None
    with pytest.raises(ValueError):
        mapping.report_spans(F.col("t"), 5, 5)


def plain_place(text, mention, left, right):
    """(start, end, adjacent, words) of the best place, or None."""
    norm = lambda t: re.sub(r"\s+", " ", (t or "").lower()).strip(" ")
    if not (mention or "").strip():
        return None
    places = [m.span() for m in re.finditer(re.escape(mention), text)] or [m.span() for m in re.finditer(r"\s+".join(map(re.escape, mention.split())), text, re.I)]
    lw, rw = norm(left).split(), norm(right).split()

    def fit(span):
        before = norm(text[max(0, span[0] - max(600, 2 * len(left or ""))) : span[0]])
        after = norm(text[span[1] : span[1] + max(600, 2 * len(right or ""))])
        nl = max([n for n in range(1, len(lw) + 1) if before.endswith(" ".join(lw[-n:]))], default=0)
        nr = max([n for n in range(1, len(rw) + 1) if after.startswith(" ".join(rw[:n]))], default=0)
        return (int(bool(lw) and nl == len(lw)) + int(bool(rw) and nr == len(rw)), nl + nr, -span[0])

    if not places:
        return None
    best = max(places, key=fit)
    return (*best, *fit(best)[:2])


def test_mentions_against_plain_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    given = {r["doc_id"]: r for r in Q.mentions_of(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["start"], r["end"], r["adjacent"], r["words"]) for r in Q.mention_alignment(spark, sf_dir).collect()}
    assert got == {k: plain_place(texts[k], m["mention"], m["context_left"], m["context_right"]) or (None,) * 4 for k, m in given.items()}


def test_mention_edges(spark):
    docs = spark.createDataFrame([(1, "Run a.b now. then a.b  here; A.B\nend", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, mention string")
    rows = [(1, 1, "a.b", "then", "here;"), (2, 1, "a.b", None, None), (3, 1, "A.B END", "", ""), (4, 1, " ", "a", "b"), (5, 1, "axb", None, None), (6, 2, "a", None, None), (7, 3, "a", None, None), (8, 9, "a", None, None), (9, 1, None, None, None), (10, 1, "\\E", None, None)]
    mentions = spark.createDataFrame(rows, "mention_id long, doc_id long, mention string, context_left string, context_right string")
    got = {r["mention_id"]: (r["start"], r["end"]) for r in mapping.align_mentions(docs, mentions).collect()}
    assert got == {1: (18, 21), 2: (4, 7), 3: (29, 36)} | {k: (None, None) for k in range(4, 11)}
    assert mapping.align_mentions(docs, mentions.limit(0)).count() == 0


def plain_near(gap, objects):
    def share(a, b):
        return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) / min(a[2], b[2])

    def iou(a, b):
        both = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    kept = []
    for item, score, *box in sorted(objects, key=lambda o: (-o[1], o[0])):
        band = box[1] <= gap[1] + 2 * gap[3] and box[1] + box[3] >= gap[1] - 0.25 * gap[3]
        if band and share(gap, box) >= 0.25 and all(iou(box, k[1]) < 0.7 for k in kept):
            kept.append((item, box))
    return [k[0] for k in kept[:6]]


def test_gap_neighbours(spark):
    rng = np.random.default_rng(3)
    objects = [(im, i, float(rng.integers(0, 5)) / 5, *(float(x) for x in (rng.integers(0, 60), rng.integers(0, 30), 20, 10))) for im in range(6) for i in range(25)]
    gaps = [(im, g, float(rng.integers(0, 60)), float(rng.integers(0, 30)), 25.0, 12.0) for im in range(7) for g in range(2)]
    o = spark.createDataFrame(objects, "image long, item long, score double, left double, top double, width double, height double")
    g = spark.createDataFrame(gaps, "image long, gap long, left double, top double, width double, height double")
    found = {}
    for r in mapping.near_gaps(o, g, image="image", gap="gap", item="item").orderBy("place").collect():
        found.setdefault((r["image"], r["gap"]), []).append(r["item"])
    want = {(im, gap): plain_near(box, [x[1:] for x in objects if x[0] == im]) for im, gap, *box in gaps}
    assert found == {k: v for k, v in want.items() if v}


def test_fixed_encoding_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=16)) for i in range(4) for _ in range(5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data] + [(9, None)], "item long, v array<double>")
    for query, centre in ((True, False), (False, True)):
        got = {r["item"]: r["fde"] for r in mapping.fixed_encoding(df, dims=16, planes=2, to=4, query=query, centre=centre, unit=True).collect()}
        assert set(got) == {0, 1, 2, 3}
        for item in got:
            m = np.array([v for i, v in data if i == item])
            m = m - m.mean(0) if centre else m
            out = []
            for r in range(2):
                side = (m @ np.array(mapping.gaussian_planes(16, 2, r)).T > 0).astype(int)
                bucket = side[:, 0] * 2 + (side[:, 0] ^ side[:, 1])
                shown = m @ np.array(mapping.sign_projection(16, 4, 1000 + r)).T
                out += [(shown[bucket == b].sum(0) if query else shown[bucket == b].mean(0)) if (bucket == b).any() else np.zeros(4) for b in range(4)]
            want = np.concatenate(out)
            assert np.allclose(got[item], want / np.linalg.norm(want))


def test_tables_and_vectors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(X.table_count(F.lit("a\n| h | k |\n|---|:--|\n| 1 | 2 |\n\n  |x|\n- - |\n|y|\n|z|"))) == 2
    assert one(X.table_count(F.lit(""))) == 0 and one(X.table_count(F.lit("|a|"))) == 0
    v = one(X.hash_vector(F.lit("To be, or not to be 7")))
    assert sum(v) == 7 and len(v) == 64 and sorted(v)[-2:] == [2.0, 2.0]
    assert sum(one(X.hash_vector(F.lit("")))) == 0


def test_records():
    record = {"menu": [{"nm": "tea", "price": 3, "sub": [{"nm": "milk"}]}, "loose"], "total": {"price": "4", "none": None}, "x": ""}
    assert records.text_leaves(json.dumps(record)) == [("menu[0].nm", "tea"), ("menu[0].sub[0].nm", "milk"), ("total.price", "4"), ("x", "")]
    assert records.text_leaves(None) == records.text_leaves("{") == records.text_leaves('"a"') == []
    schema = {"properties": {"a": {"$ref": "#/$defs/p~1q", "title": "A"}, "b": {"items": {"$ref": "#/$defs/n"}}}, "$defs": {"p/q": {"$ref": "#/$defs/n"}, "n": {"type": "number"}}}
    assert records.inline_references(schema) == {"properties": {"a": {"type": "number", "title": "A"}, "b": {"items": {"type": "number"}}}}
    for bad in ({"a": {"$ref": "#/$defs/x"}, "$defs": {"x": {"y": {"$ref": "#/$defs/x"}}}}, {"a": {"$ref": "#/no"}}, {"a": {"$ref": "http://x"}}):
        with pytest.raises(ValueError):
            records.inline_references(bad)
    assert re.fullmatch(records.tool_pattern(["a.b", "c", "a.b"]), "a.b") and not re.fullmatch(records.tool_pattern(["a.b", "c"]), "axb")
    assert records.tool_pattern(["a", "c"], "c") == "(?:c)"
    with pytest.raises(ValueError):
        records.tool_pattern(["a"], "b")


def test_functions_for_sql(spark):
    backends.register_encoder(spark, "embed_lengths", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [r["v"] for r in spark.sql("SELECT embed_lengths(t) AS v FROM VALUES ('abc'), (NULL) x(t)").collect()] == [[3.0, 1.0], [0.0, 1.0]]
    backends.register_extractor(spark, "find_numbers", {"n": "[0-9]+"})
    got = spark.sql("SELECT t, start, end, label, match FROM VALUES ('a 12 3'), (NULL) x(t), LATERAL find_numbers(t)").collect()
    assert sorted(tuple(r) for r in got) == [("a 12 3", 2, 4, "n", "12"), ("a 12 3", 5, 6, "n", "3")]
    pairs = spark.createDataFrame([("q", "aa", 0), ("q", "b", 1), ("q", "cc", 2), ("r", "d", 0)], "query string, doc string, place long")
    best = backends.rerank(pairs, lambda key, items: [len(x) for x in items], top=2)
    assert sorted((r["query"], r["doc"], r["rank"]) for r in best.collect()) == [("q", "aa", 0), ("q", "cc", 1), ("r", "d", 0)]


def test_files_bundles_and_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pattern = lambda i, **more: {"type": "attack-pattern", "name": f"n{i}", "external_references": [{"external_id": "CAPEC-1"}, {"external_id": i}], **more}
    objects = [pattern("T2"), pattern("T1.001"), pattern("T3", revoked=True), pattern("T4", x_mitre_deprecated=True), pattern("X5"), {"type": "tool"}]
    (tmp_path / "in" / "b.json").write_text(json.dumps({"type": "bundle", "objects": objects}, indent=1))
    (tmp_path / "in" / "note.txt").write_text("abc")
    path = str(tmp_path / "in")
    assert [r["technique_id"] for r in readers.techniques(spark, path + "/b.json").collect()] == ["T1.001", "T2"]
    assert readers.techniques(spark, path + "/b.json", active_only=False).count() == 4
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in readers.list_files(spark, path, "*.txt").collect()] == [("note.txt", 3)]
    root = str(tmp_path / "out")
    assert spark.read.parquet(jobs.publish_run(spark.range(3), root, "one")).count() == 3
    with pytest.raises(FileExistsError):
        jobs.publish_run(spark.range(3), root, "one")
    with pytest.raises(Exception, match="stop here"):
        jobs.publish_run(spark.range(1).select(F.raise_error(F.lit("stop here")).cast("int").alias("x")), root, "two")
    assert (tmp_path / "out" / "failed" / "two").exists() and not (tmp_path / "out" / "runs" / "two").exists()
    with pytest.raises(ValueError):
        jobs.publish_run(spark.range(1), root, "a/b")
