"""Sharding, language, packing, near-duplicates and toxicity."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty, prose, rows
from vectrail.llm import components, langid, packing, sharding, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(7)]
    owner = sharding.fill_table(names, 1009)
    share = Counter(owner)
    assert set(share) == set(range(7)) and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    # slow statement of the same rule
    order = [[(sharding._hash(f"offset:{s}") % 1009 + j * (sharding._hash(f"skip:{s}") % 1008 + 1)) % 1009 for j in range(1009)] for s in names]
    slow, turn = {}, 0
    while len(slow) < 1009:
        slot = next(x for x in order[turn % 7] if x not in slow)
        slow[slot] = turn % 7
        turn += 1
    assert owner == [slow[i] for i in range(1009)]
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 1000)


def test_sharding(spark):
    docs = documents(spark)
    got = sharding.assign_shards(docs, "doc_id", ["a", "b", "c"])
    assert got.count() == docs.count() and got.where("shard IS NULL OR slot IS NULL").count() == 0
    assert set(got.columns) == {*docs.columns, "shard"}
    assert got.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sharding.assign_shards(empty(spark), "doc_id", ["a"]).count() == 0


def learned(spark, sample, **sizes):
    """The model of a table of (lang, text), in two partitions."""
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    found = [(i, text.decode(), lang) for i, (lang, text) in zip(ids, sample, strict=False)]
    return langid.train(spark.createDataFrame(found, "doc_id long, text string, lang string").repartition(2), **sizes)


@pytest.mark.parametrize("share", [0.0, 0.05])
def test_code_lengths_are_those_of_the_context_tree(spark, share):
    sample = [("x", b"abracadabra abra"), ("y", b"banana bandana"), ("x", b"cadabra"), ("y", b""), ("x", b"Z\xc3\xa9")]
    model = learned(spark, sample, order=2, least_share=share)

    def slow(lang, text):
        counts, total = defaultdict(Counter), 0
        for known, s in sample:
            if known == lang:
                s = b"\n\n" + s.lower()
                total += len(s) - 2
                for i in range(2, len(s)):
                    for k in range(3):
                        counts[s[i - k : i]][s[i]] += 1
        counts = {c: {b: n for b, n in seen.items() if n >= share * total} for c, seen in counts.items()}

        def p(context, b):
            seen = counts.get(context, {})
            n, d = sum(seen.values()), len(seen)
            if b in seen:
                return seen[b] / (n + d)
            lower = p(context[1:], b) if context else 1 / 256
            return lower * d / (n + d) if n else lower

        s = b"\n\n" + text
        return -sum(np.log2(p(s[i - 2 : i], s[i])) for i in range(2, len(s)))

    for text in (b"abra", b"bananas", b"zzz", b"a", b"\xc3\xa9\xff"):
        for _ in range(2):  # computed, then from the cache
            assert model.bits([b"", text])[1] == pytest.approx([slow("x", text), slow("y", text)], rel=1e-4)


def test_long_texts_are_scored_and_counted_in_blocks(spark, monkeypatch):
    sample = [("x", b"abracadabra" * 40), ("y", b"banana" * 30)]
    model = learned(spark, sample, order=3)
    text = b"abra banana cad" * 50
    whole = model.bits([text, b"", b"ban"])
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert model.bits([text, b"", b"ban"]) == pytest.approx(whole, rel=1e-5)

    def counts(most):
        return Counter(c for _, _, codes in langid.coded_blocks([text, b"", b"ban"], most) for c in codes.tolist())

    assert counts(64) == counts(1 << 20) and sum(counts(64).values()) == len(text) + 3
    monkeypatch.setattr(langid, "CACHE_BITS", 4)  # nearly every slot is fought for
    small = langid.CodeLengths(dict(zip(model.langs, model.trees, strict=True)))
    for _ in range(3):
        assert small.bits([text, b"", b"ban"]) == pytest.approx(whole, rel=1e-5)


CYRILLIC = {
    "uk": "\u0456 \u0439\u043e\u0433\u043e \u0449\u043e \u0454 \u043d\u0430\u0439\u0431\u0456\u043b\u044c\u0448\u0435 \u043c\u0456\u0441\u0442\u043e \u0457\u0457 \u043a\u0440\u0430\u0457\u043d\u0430 \u0440\u0456\u043a \u0432\u0456\u043d",
    "ru": "\u0438 \u0435\u0433\u043e \u0447\u0442\u043e \u044d\u0442\u043e \u0441\u0430\u043c\u044b\u0439 \u0433\u043e\u0440\u043e\u0434 \u0441\u0442\u0440\u0430\u043d\u0430 \u0433\u043e\u0434 \u043e\u043d \u0431\u044b\u043b \u043c\u044b",
    "el": "\u03ba\u03b1\u03b9 \u03c4\u03bf \u03b7 \u03c0\u03cc\u03bb\u03b7 \u03b5\u03af\u03bd\u03b1\u03b9 \u03bc\u03b5\u03b3\u03ac\u03bb\u03b7 \u03c7\u03ce\u03c1\u03b1 \u03ad\u03c4\u03bf\u03c2",
}


def test_minority_languages_beside_a_large_latin_one(spark):
    rng = np.random.default_rng(4)
    draw = lambda words, n: " ".join(rng.choice(words, n))
    found = [(i, prose(i, 200), "la") for i in range(600)]
    for k, (lang, words) in enumerate(CYRILLIC.items()):
        found += [(1000 * (k + 1) + i, draw(words.split(), 12), lang) for i in range(60)]
    docs = spark.createDataFrame(found, "doc_id long, text string, lang string").repartition(3)
    got = langid.identify(docs).join(docs, "doc_id").where("held_out AND lang != 'la'")
    assert got.count() > 20 and got.where("lang != lang_pred").count() == 0
    # four words are enough
    short = [(k, draw(CYRILLIC[lang].split(), 4), lang) for k, lang in enumerate(["uk", "ru", "el"] * 10)]
    got = langid.predict(spark.createDataFrame(short, "doc_id long, text string, lang string"), langid.train(docs)).collect()
    right = sum(r["lang_pred"] == short[r["doc_id"]][2] for r in got)
    assert right >= 28


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.selectExpr("avg(int(lang = lang_pred)) AS x").first()["x"] > 0.97


def test_language_edges(spark):
    docs = documents(spark)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["lang_pred"])
    assert by[100] == by[101] == by[102] == {"und"} and by[113] == {"und"} and "und" not in by[0]
    kept = langid.keep_identified(docs, 0.0)
    assert kept.columns == docs.columns
    assert {r["lang_pred"] for r in langid.identify(empty(spark)).collect()} == set()
    no_labels = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in no_labels} == {"und"}


def test_tokenizer_gives_the_library_s_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = packing.ByteTokenizer(packing.default_tokenizer())
    texts = [t or "" for _, t, *_ in rows()] + ["a  b\n\n c \t", "don't we'll  x", "\U0001f600é 12a", "<|endoftext|> ok", "a <|endoftext|><|endoftext|>b  <|endoftext|", "   ", "\n", "\u0130\u00df \u4e2d\u6587\u3000x\u00a0 y"]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    got = packing.pack(documents(spark), group_size=16).collect()
    mine = packing.ByteTokenizer(packing.default_tokenizer())
    want = Counter()
    for i, t, *_ in rows():
        ids = mine.encode(t or "") + b"\0\0\0\0"
        want[(i, len(ids) // 4)] += len(ids) // 4
    have = Counter()
    texts = defaultdict(list)
    for i, t, *_ in rows():
        texts[i].append(mine.encode(t or "") + b"\0\0\0\0")
    sequences = defaultdict(list)
    for r in got:
        have[(r["doc_id"], r["doc_tokens"])] += r["length"]
        piece = [x[4 * r["start"] : 4 * (r["start"] + r["length"])] for x in texts[r["doc_id"]] if len(x) == 4 * r["doc_tokens"]]
        assert r["ids_crc32"] in map(zlib.crc32, piece)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024
    assert packing.pack(empty(spark)).count() == 0


def test_longest_first_to_the_cheapest_with_room():
    pieces, n = packing.pack_lengths([900, 100, 24, 1000, 24], 1024)
    assert n == 2 and sum(p[2] for p in pieces) == 2048
    at = {p[0]: p[3] for p in pieces}
    assert at[0] == at[1] == at[2] and at[3] == at[4]
    assert packing.pack_lengths([], 1024) == ([], 0)


def test_costs_are_balanced():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 2048).tolist()
    pieces, n = packing.pack_lengths(lengths)
    cost = lambda k: packing.LINEAR * k + packing.QUADRATIC * k * k
    # the same order and room, but to the first sequence with room rather than the cheapest
    room, first = np.full(sum(lengths) // 1024, 1024), np.zeros(sum(lengths) // 1024)
    for k in sorted(lengths, reverse=True):
        fits = np.flatnonzero(room >= k)
        if len(fits):
            room[fits[0]] -= k
            first[fits[0]] += cost(k)
    mine = np.bincount([p[3] for p in pieces], [cost(p[2]) for p in pieces], n)[: len(first)]
    assert mine.std() < first.std() and mine.max() <= first.max()


def simhash_slow(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("trie_rows", [1024, 4])
def test_near_duplicates(spark, monkeypatch, trie_rows):
    monkeypatch.setattr(simhash, "TRIE_ROWS", trie_rows)
    found = rows() + [(200 + i, prose(5, 4000).replace("the", "THE", i) + " x" * i, "en", "s0") for i in range(8)]
    fps = [simhash_slow(t) for _, t, *_ in found]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    roots = union(len(fps), pairs)
    least = {}
    for (i, *_), r in zip(found, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    got = simhash.near_duplicates(documents(spark, found)).collect()
    want = Counter((i, f"{f:016x}", least.get(r)) for (i, *_), f, r in zip(found, fps, roots, strict=True))
    assert Counter(map(tuple, got)) == want
    kept = simhash.keep_one_each(documents(spark, found))
    assert kept.columns == documents(spark).columns and kept.count() == len(set(roots))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_trie_pairs_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))]))
    got = {tuple(sorted(p)) for i, j in simhash.trie_pairs(fps, np.array([0]), np.array([len(fps)])) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for b in range(len(fps)) for a in range(b) if int(fps[a] ^ fps[b]).bit_count() <= 4}
    assert got == want


def test_classes_deal_out_all_bits():
    for deal in simhash.DEALS:
        masks = [m & (1 << 64) - 1 for m in simhash.classes(deal)]
        assert sum(masks) == (1 << 64) - 1 and len(masks) == 5 and all(10 <= m.bit_count() <= 15 for m in masks)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre} | {centre ^ 1 << int(a) ^ 1 << int(b) ^ 1 << int(c) for a, b, c in rng.integers(0, 62, (3000, 3))}
    far = [int(x) for x in rng.integers(0, 1 << 62, 300)]
    frame = spark.createDataFrame([(f,) for f in {*fps, *far}], "fp long")
    links = [tuple(r) for r in simhash.fingerprint_links(frame).collect()]
    order = sorted(fps)
    at = {f: i for i, f in enumerate(order)}
    mine = union(len(order), [(at[a], at[b]) for a, b in links if a in at and b in at])
    assert set(mine) == {0} and not any(a in far or b in far for a, b in links)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    edges += [(3000, i) for i in range(3001, 4500)]  # a hub
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in (100, 101, 102)}, **{i: 3000 for i in range(3000, 4500)}}


def test_forward_backward_against_all_taggings():
    odds = np.zeros((1, toxicity.CHAIN))
    odds[0, :4] = [0.5, -1.0, 2.0, 0.1]
    move = np.array([[0.2, -0.5], [-0.3, 0.9]])
    weight, ones, pairs = 0.0, np.zeros(4), np.zeros((2, 2))
    for tags in np.ndindex(2, 2, 2, 2):
        w = np.exp(sum(odds[0, i] * t for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        weight += w
        ones += w * np.array(tags)
        for a, b in zip(tags, tags[1:], strict=False):
            pairs[a, b] += w
    chance, seen = toxicity.forward_backward(odds, np.array([4]), move)
    assert chance[0, :4] == pytest.approx(ones / weight) and seen == pytest.approx(pairs / weight) and chance[0, 4:].sum() == 0


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score_toxicity(some, labels).join(labels, "doc_id").where("held_out")
    r = got.selectExpr("avg(int(predicted = toxic)) AS right", "avg(if(toxic = 1, predicted, null)) AS found", "avg(if(toxic = 0, predicted, null)) AS wrong").first()
    assert r["right"] > 0.97 and r["found"] > 0.85 and r["wrong"] < 0.02


def test_toxicity_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] < 0.3 and r["predicted"] == 0 for r in got)
    assert toxicity.score_toxicity(empty(spark), labels.limit(0)).count() == 0


def labelled_texts(spark):
    clean = [f"clean words of no harm here again number{i}" for i in range(200)]
    toxic = [f"you are vile scumbag here again number{i}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(i, int(i >= 200)) for i in range(300)], "doc_id long, toxic int")


ODD = ["\u0130stanbul you are vile scumbag here", "\U0001f600 You ARE vile, scumbag", "\u0130\u0130 VILE", "clean words here", "", "vile " * 70]


def test_scores_and_offsets_against_loops(spark):
    docs, labels = labelled_texts(spark)
    model = toxicity.train(docs, labels)
    every = [r["text"] for r in docs.collect()] + ODD
    frame = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string").unionByName(docs)
    got = {r["text"]: r for r in toxicity.predict(frame, model).join(frame, "doc_id").collect()}

    def slow(text):
        places = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        chance = []
        for at in range(0, len(places), 64):
            odds = [model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(text[a:b])) for a, b in places[at : at + 64]]
            move = np.exp(model.transitions)
            forward = [np.array([1.0, np.exp(odds[0])])]
            for o in odds[1:]:
                forward.append(forward[-1] @ move * np.array([1.0, np.exp(o)]))
            back = [np.ones(2)]
            for o in reversed(odds[1:]):
                back.insert(0, move @ (back[0] * np.array([1.0, np.exp(o)])))
            chance += [(f * b)[1] / (f * b).sum() for f, b in zip(forward, back, strict=True)]
        # chains without any known feature do not count for the greatest chance
        known = [k for k in range(len(places)) if any(model.weights.get(f) for a, b in places[k // 64 * 64 : k // 64 * 64 + 64] for f in toxicity.features(text[a:b]))]
        x = np.array([1, np.log1p(sum(chance)), np.sqrt(sum(chance) / max(1, len(places))), max((chance[k] for k in known), default=0.0)])
        return 1 / (1 + np.exp(-x @ model.document)), ",".join(f"{a}:{b}" for k, (a, b) in enumerate(places) if k in known and chance[k] >= 0.5)

    for text in every:
        score, spans = slow(text)
        assert got[text]["score"] == pytest.approx(score, abs=1e-6) and got[text]["spans"] == spans
        assert got[text]["predicted"] == int(score >= 0.3)
    assert "17:21" in got[ODD[0]]["spans"] and "10:14" in got[ODD[1]]["spans"] and got[ODD[3]]["spans"] == ""


def test_long_labelled_texts_are_learned_from(spark):
    docs, labels = labelled_texts(spark)
    tail = F.when(F.col("doc_id") >= 200, F.concat(F.repeat(F.lit("clean words of no harm "), 2500), F.col("text"))).otherwise(F.col("text"))
    model = toxicity.train(docs.withColumn("text", tail), labels)
    assert model.weights["=vile"] > 0.5
    # counted chains weigh as much as chains that are there
    part = docs.select((F.col("doc_id") >= 200).cast("int").alias("toxic"), tail.alias("text"))
    names, strong = toxicity.feature_evidence(part)
    chains = toxicity.cut_chains(part, names).toArrow()
    n = sum(chains["length"].to_numpy() * chains["times"].to_numpy())
    assert n == sum(len(re.findall(r"\w+", r["text"])) for r in part.collect()) and strong
