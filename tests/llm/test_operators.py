"""Operators against brute force on a fixture of hard cases, and on the smallest given tables."""

import hashlib
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import chat, components, decontaminate, jaccard, packing, quality, queries, secrets, shards, stage, substrings, suffixes, toxicity
from cohortlab.llm.trigrams import trigram_query


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_trigram_queries():
    alts = trigram_query(secrets.RULES[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in alts and frozenset({"api", "pik", "ike", "key"}) in alts
    assert trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert trigram_query(r"[0-9a-f]+") is None and trigram_query("ab|secret") is None


def test_secrets(docs, rows, empty):
    found = secrets.scan_secrets(docs)
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    text = F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = [F.size(F.filter(F.transform("secrets", lambda s: s["kind"]), (lambda k: lambda s: s == k)(k))) for k in secrets.BASE]
    assert got(found, "doc_id", *count, F.sha2(text, 256)) == Counter((r[0], *brute.secrets(r[1])) for r in rows)
    kinds = {s["kind"] for r in found.collect() for s in r["secrets"]}
    assert {"private_key", "jwt"} <= kinds
    assert secrets.scan_secrets(empty).count() == 0


def test_redaction(docs, rows):
    out = {(r["doc_id"], r["label"]): r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert out[3, "y"] is None and out[6, "y"] == "one two three"
    again = secrets.scan_secrets(secrets.redact_secrets(docs))
    assert again.where(F.size("secrets") > 0).count() == 0
    assert "abcdefGHIJ12345" not in out[15, "y"] and secrets.MARK in out[15, "y"]


def test_private_keys_go_with_their_bodies(spark):
    import base64
    import textwrap
    rng = np.random.default_rng(8)
    body = lambda n: textwrap.wrap(base64.b64encode(rng.bytes(n)).decode(), 64)
    block = lambda kind, lines, head="": "\n".join([f"-----BEGIN {kind}-----", *([head, ""] if head else []), *lines, f"-----END {kind}-----"])
    b = [body(1200), body(1700), body(2500), body(600), body(700), body(900), body(60000), body(40)]
    b[0][3] = "deadbeefdeadbeef0123" + b[0][3][20:]  # a hex run inside a body
    texts = ["before " + block("RSA PRIVATE KEY", b[0], "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011") + "\nafter",
             "before " + block("PGP PRIVATE KEY BLOCK", [*b[1], "=aB3d"], "Version: GnuPG v1") + "\nafter",
             'before "' + block("PRIVATE KEY", b[2]).replace("\n", "\\n") + '" after',
             "before -----BEGIN EC PRIVATE KEY-----\n" + "\n".join(b[3]) + "\nafter the body, no end",
             "before -----BEGIN PRIVATE KEY----- " + " ".join(b[4]) + " after -----BEGIN X----- " + block("PRIVATE KEY", b[5]) + " after",
             "before " + block("OPENSSH PRIVATE KEY", b[6]) + " after",
             "before -----BEGIN PRIVATE KEY----- after " + "some-words " * 20000 + " after",
             "before after -----BEGIN PRIVATE KEY-----\n" + "\n".join(b[7])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    for i, own in enumerate([[0], [1], [2], [3], [4, 5], [6], [], [7]]):
        assert all(line not in out[i] and line[:12] not in out[i] for k in own for line in b[k]), i
        assert out[i].startswith("before ") and "after" in out[i] and "PRIVATE KEY" not in out[i] and out[i].count("after") == texts[i].count("after"), i
    assert secrets.scan_secrets(df.limit(0).union(secrets.redact_secrets(df))).where(F.size("secrets") > 0).count() == 0
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] == "private_key"] for r in secrets.scan_secrets(df).collect()}
    assert all(len(spans[i]) == 1 + (i == 4) for i in spans) and spans[5] == [(7, len(texts[5]) - 6)]


def test_many_matches_in_one_text(spark):
    text = "0123456789abcdef " * 3000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = secrets.scan_secrets(df).first()
    assert [(s["start"], s["end"]) for s in r["secrets"]] == [(17 * i, 17 * i + 16) for i in range(3000)]


def test_quality_base(docs, rows, empty):
    out = quality.quality_rules(docs)
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == \
        Counter((r[0], *brute.quality(r[1])) for r in rows)
    assert out.where("kept and base_failed").count() == 0
    assert quality.quality_rules(empty).count() == 0


def test_robust_distance_rejects_planted_outliers(spark):
    from cohortlab.llm.stage import stage
    rng = np.random.default_rng(3)
    names = ["x", "y"]
    good = rng.multivariate_normal([1, 2], [[1, .8], [.8, 1]], 600)
    bad = rng.multivariate_normal([4, -3], [[.1, 0], [0, .1]], 90)
    df = spark.createDataFrame([(float(a), float(b), g, k) for k, pts in ((0, good), (1, bad)) for i, (a, b) in enumerate(pts) for g in ("g",)],
                               "x double, y double, g string, bad int")
    df = stage(df.union(df.limit(5).withColumn("g", F.lit(None).cast("string"))), "t")
    out = quality.robust_distance(df, ["g"], dict.fromkeys(names, 1e-4), F.lit(True), median_chi2=1.386).collect()
    assert all(r["distance"] is None for r in out if r["g"] is None)
    assert min(r["distance"] for r in out if r["bad"] and r["g"]) > 25
    good_d = sorted(r["distance"] for r in out if not r["bad"] and r["g"])
    assert good_d[int(len(good_d) * .97)] < 14
    # the kept half gives the plain estimate of the good rows, near enough
    inv = np.linalg.inv(np.cov(good.T))
    plain = sorted(float((p - good.mean(0)) @ inv @ (p - good.mean(0))) for p in good)
    assert np.corrcoef(good_d, plain)[0, 1] > .97


def test_small_groups_get_a_verdict(spark):
    """Groups of one to five rows: their gross outliers go, their plain rows stay, and each row has a distance."""
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(400)]
    text = lambda bad: " ".join(w + "#$%!?" * 6 if bad else w for w in rng.choice(words, 60 + int(rng.integers(0, 80))))
    sizes = [("en", "big", 300, 0), ("de", "big", 80, 0)] + [
        (lang, f"s{good}{bad}", good, bad) for lang in ("en", "de", "xx") for good, bad in ((1, 0), (0, 1), (2, 1), (4, 1))]
    data = [(text(k >= good), lang, source, k >= good) for lang, source, good, bad in sizes for k in range(good + bad)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "doc_id long, text string, lang string, source string, bad boolean")
    out = quality.quality_rules(df).collect()
    assert len(out) == len(data) and all(r["distance"] is not None and not r["base_failed"] for r in out)
    assert [(r["lang"], r["source"], r["bad"], round(r["distance"])) for r in out if r["kept"] == r["bad"]] == []


def test_ordinal_regression():
    rng = np.random.default_rng(1)
    n, true = 4000, np.array([2.0, -1.0, 0.0])
    x = rng.random((n, 3)) < .5
    score = x @ true + rng.logistic(size=n)
    grade = (score > .5).astype(int) + (score > 2)
    doc, col = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(doc, col, grade, 3, 3)
    assert np.abs(w - true).max() < .25 and np.abs(cuts - [.5, 2]).max() < .25


def test_toxicity_features_in_slices(monkeypatch):
    """Long texts cut in pieces, and many texts cut in runs, have the features of the whole."""
    monkeypatch.setattr(toxicity, "SLICE", 97)
    texts = [b"", "Ünï cödé W\x00rds and-more ".encode() * 40, b"q" * 900, b"short one", b"short two", b" " * 500, b"x y" * 200]
    want = toxicity._distinct(*toxicity.text_features(texts))
    got = [toxicity._slice_features(texts[a:b], None) for a, b in toxicity._slices(texts)]
    starts = [a for a, _ in toxicity._slices(texts)]
    assert np.array_equal(want[0], np.concatenate([d + a for a, (d, _) in zip(starts, got)]))
    assert np.array_equal(want[1], np.concatenate([f for _, f in got]))
    assert b"".join(toxicity._pieces(texts[1])) == texts[1]


def test_toxicity_held_out(spark, empty):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(500)]
    data = []
    for i in range(1200):
        t = list(rng.choice(words, 40))
        bad = i % 6 == 0
        if bad:
            t[5:5 + 1 + i % 4] = list(rng.choice(["vile", "nasty", "awful"], 1 + i % 4))
        data.append((i, " ".join(t), int(bad)))
    df = spark.createDataFrame(data + [(5000, None, 0), (5001, "", 1)], "doc_id long, text string, toxic int")
    labels = df.select("doc_id", F.when(F.col("doc_id") < 600, F.col("toxic")).alias("toxic"))
    model = toxicity.train(df.select("doc_id", "text"), labels)
    out = toxicity.score_severity(df.withColumn("severity", F.lit("clash")).withColumnRenamed("toxic", "truth"), model).where("doc_id >= 600 and doc_id < 5000").collect()
    assert np.mean([r["toxic"] == bool(r["truth"]) for r in out]) > .99
    assert toxicity.score_severity(empty, model).count() == 0
    nothing = toxicity.train(df.select("doc_id", "text"), labels.where("toxic = 0"))
    assert toxicity.score_severity(df.drop("toxic"), nothing).where("toxic").count() == 0


def test_toxicity_of_a_rare_language(spark):
    """A language with under 2% of the toxic rows has features of its own."""
    rng = np.random.default_rng(4)
    words, rare = [f"word{i}" for i in range(300)], [f"palabra{i}" for i in range(60)]
    data = []
    for kind, n, own, toxic in (("many", 2000, words, 0), ("many", 400, words + ["vile"] * 60, 1), ("few", 100, rare, 0), ("few", 16, rare, 1)):
        for i in range(n):
            t = list(rng.choice(own, 20))
            if kind == "few" and toxic:
                t[3] = "odioso"
            data.append((len(data), " ".join(t), toxic, kind == "few" and i % 2 == 0))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int, held boolean")
    model = toxicity.train(df.select("doc_id", "text"), df.where("not held").select("doc_id", "toxic"))
    out = toxicity.score_severity(df.withColumnRenamed("toxic", "truth"), model).where("held").collect()
    assert sum(r["truth"] for r in out) == 8 and all(r["toxic"] == bool(r["truth"]) for r in out)


def test_sharding(docs, rows, empty):
    out = shards.interleave(docs.drop("text"), 4, tie=("doc_id",)).collect()
    size = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(size.values()) - min(size.values()) <= 1
    for s, n in size.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert shards.interleave(empty, 4).count() == 0


def test_sharding_mixture(spark):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got_ = shards.interleave(df, 24).groupBy("shard", "source").count().collect()
    total = Counter(r["source"] for r in df.collect())
    assert all(abs(r["count"] - total[r["source"]] / 24) <= 1 for r in got_)


def test_suffixes(docs, rows, empty):
    want = Counter((r[0], *b) for r, b in zip(rows, brute.suffixes([r[1] for r in rows])))
    out = suffixes.dedup_suffixes(docs)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out.collect())
    assert suffixes.dedup_suffixes(empty).count() == 0


def test_loser_tree_merge():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 30))) for _ in range(k)]
        coded = [(r, suffixes.front_code(r)[0] if r else []) for r in runs]
        merged = [(runs[r][i], n) for r, i, n in suffixes.merge_runs(coded)]
        assert [s for s, _ in merged] == sorted(x for r in runs for x in r)
        assert all(n == suffixes.common(a, b) for (a, _), (b, n) in zip(merged, merged[1:]))


def test_substrings(docs, rows, empty):
    want = Counter((r[0], *b) for r, b in zip(rows, brute.substrings([r[:2] for r in rows])))
    for first in (7, 25, 50):
        out = substrings.dedup_substrings(docs, 50, first)
        assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substrings.dedup_substrings(empty).count() == 0


def test_jaccard(docs, rows, empty):
    want = Counter((r[0], *b) for r, b in zip(rows, brute.jaccard([r[:2] for r in rows])))
    assert got(jaccard.jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == want
    assert jaccard.jaccard_groups(empty).count() == 0


def test_jaccard_wide_clusters(spark):
    """Near copies in clusters of many blocks, with members that link through one other only."""
    rng = np.random.default_rng(9)
    rows = []
    for b in range(3):
        base = [f"b{b}x{i}" for i in range(60)]
        for _ in range(40):
            t = list(base)
            for i in rng.integers(0, 60, rng.integers(0, 4)):
                t[i] = f"e{rng.integers(1000)}"
            rows.append((len(rows), " ".join(t)))
        for cut in range(4, 40, 4):  # chains that leave the base bit by bit
            rows.append((len(rows), " ".join(base[cut:] + [f"c{b}y{i}" for i in range(cut)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter((i, *b) for (i, _), b in zip(rows, brute.jaccard(rows)))
    for block in (8, 512):
        assert got(jaccard.jaccard_groups(df, block=block), "doc_id", "n_shingles", "component_id") == want


@pytest.mark.parametrize("block", [8, 512])
def test_jaccard_of_templates(spark, block):
    """A template with words of a document's own, at its end, in its middle or mixed in: pairs
    just above and just below the limit, sizes that differ, copies of some."""
    rng = np.random.default_rng(4)
    template, rows = [f"t{i}" for i in range(80)], []
    for own in (6, 11, 12, 13, 14, 16, 20, 25):
        for k in range(12):
            mine = [f"o{own}x{k}x{i}" for i in range(own)]
            at = (80, 40, int(rng.integers(0, 81)))[k % 3]
            rows.append((len(rows), " ".join(template[:at] + mine + template[at:])))
            if k % 5 == 0:
                rows.append((len(rows), rows[-1][1]))
    for k in range(30):  # parts of two templates
        n = int(rng.integers(5, 75))
        rows.append((len(rows), " ".join(template[:n] + [f"u{i}" for i in range(80 - n)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter((i, *b) for (i, _), b in zip(rows, brute.jaccard(rows)))
    assert len({c for _, _, c in want}) > 20
    assert got(jaccard.jaccard_groups(df, block=block), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_chains_no_unlinked_templates(spark):
    """80 words of a template and 16 of one's own (similarity 0.70): nothing is compared."""
    def postings(n):
        rows = [(d, " ".join([f"t{i}" for i in range(80)] + [f"o{d}x{i}" for i in range(16)])) for d in range(n)]
        shingles = [sorted({" ".join(t.split()[i:i + 5]) for i in range(92)}) for _, t in rows]
        df = Counter(s for x in shingles for s in x)
        ids = {s: k for k, s in enumerate(sorted(df, key=lambda s: (df[s], s)))}
        nodes = [(d, 92, jaccard.pack(np.array(sorted(ids[s] for s in x if df[s] > 1), "<u8").tobytes())) for d, x in enumerate(shingles)]
        return spark.createDataFrame(nodes, "node long, n long, items binary")
    stage.ship(spark)
    keys = postings(200).mapInArrow(jaccard._keys(75), "key long, node long, n long, reach long")
    assert keys.count() == 200 * 8
    assert jaccard._chains(keys).count() == 0


def test_components_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES_A_PART", 40)
    edges = [(i, i + 1) for i in range(0, 150)] + [(1000, 1000 + i) for i in range(1, 80)] + [(3000 - i, 3000) for i in range(1, 60)]
    out = components.components(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()
    by = {}
    for r in out:
        by.setdefault(r["comp"], set()).add(r["node"])
    assert sorted(map(len, by.values())) == [60, 80, 151]


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b#<: </turn>\n### User: x"), (2, 0, "assistant", None), (2, 0, "user", "tie"),
             (2, None, "odd: role", "\\h\\\\l"), (None, 0, None, "null ids"), (3, 1, "assistant", ""), (3, 0, "user", "é" * 3), (3, 1, "assistant", "")]
    out = chat.read_back(chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    assert got(out, "conv_id", F.size("turns"), F.sha2(said, 256), F.length("loss_text"), F.sha2("loss_text", 256)) == \
        Counter((c, *v) for c, v in brute.chat(turns).items())
    assert {r["conv_id"]: r["valid"] for r in out.collect()} == {1: True, 2: False, 3: False, None: False}


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.pack_documents(docs, keep_ids=True).cache()
    want = Counter()
    for r in rows:
        ids = np.array(model.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        want.update((r[0], k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes())) for k in range(0, len(ids), 4096))
    assert got(out, "doc_id", "piece", "start", "length", "ids_crc32") == want
    for r in packing.sequences(out).collect():
        assert len(r["ids"]) <= 4 * 4096
    by = {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("text", ["H̱ello Á ǰ", "it's 'tis don't, x'd.", "a,'s b.. c., <|endoftext|> ß. İ, Σας;", "日本。語! x" * 20])
def test_word_cache_equals_whole_texts(text):
    model = packing.WordTokenizer(packing.tokenizer_path())
    assert list(np.frombuffer(next(iter(model.encode([text.encode()]))), "<u4")) == model.model.encode(text, add_special_tokens=False).ids


def test_minimum_bin_slack():
    plan = packing.minimum_bin_slack({7: 4, 5: 3, 3: 9, 10: 2}, 10)
    assert all(sum(x * n for x, n in used.items()) <= 10 for _, used in plan)
    total = Counter()
    for times, used in plan:
        total.update({x: n * times for x, n in used.items()})
    assert total == {7: 4, 5: 3, 3: 9, 10: 2} and sum(t for t, _ in plan) == 10


ITEMS = [(1, " ".join(f"w{(2 * 7919 + i * i * 31 + i) % 9973}" for i in range(20, 45))), (2, "One, two: THREE"), (3, None), (4, "..."),
         (None, "five words are in here"), (2, "zzz not there"), (10, "AB ab ab ab ab ab ab ab ab ab ab")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_decontamination(spark, docs, rows, block_bytes):
    items = spark.createDataFrame([(*x, "extra") for x in ITEMS], "item_id long, text string, doc_id string")
    out = decontaminate.decontaminate(docs, items, block_bytes)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == \
        Counter((r[0], *b) for r, b in zip(rows, brute.decontaminate([r[1] for r in rows], ITEMS)))
    assert out.where("n_near_items < n_items").count() == 0


def test_decontamination_empty(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


def test_registered_queries_on_given_tables(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check = {
        "op5_suffix_dedup": (["n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.suffixes([t for _, t in docs])),
        "op6_jaccard_join": (["n_shingles", "component_id"], brute.jaccard(docs)),
        "op10_substring_dedup": (["n_words", "n_removed", "kept_sha256"], brute.substrings(docs)),
    }
    for name, (cols, want) in check.items():
        assert got(queries.QUERIES[name](spark, sf), "doc_id", *cols) == Counter((i, *w) for (i, _), w in zip(docs, want))


def test_word_tokenizer_is_exact():
    """Words cut at marks and encoded together have the ids that the whole text gives."""
    import random
    rng = random.Random(4)
    parts = ["don't", "it's", "'s", "word", "Éçole", "ß", "12", "٣", "x²", "…", "é", "ñ", "ǅ", "日本", "$$$", "###", "!?", "'", "''", "_", "\x01", "a\x01b",
             "é", "̸", "<", "--", "(", ")", "¡", " ", "🙂", "http://a.b/c?d=e", "%%%", "A"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    model = packing.WordTokenizer(packing.tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in model.model.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(model.encode([t.encode() for t in texts])) == want


@pytest.mark.parametrize("cached", [packing.CACHED_WORDS, 40])
def test_words_of_letters_are_exact(monkeypatch, cached):
    """Words of small letters, encoded without the normalizer, and capitals whose small form ends
    in a mark have the ids that the whole text gives, also when the cache is emptied between."""
    monkeypatch.setattr(packing, "CACHED_WORDS", cached)
    letters = "aeiou\u00df\u00e0\u00e9\u00f6\u00f8\u00ff\u00f7\u0131\u0130\u00d6"
    texts = [" ".join((letters[(i * j) % 15] + letters[(i + 3 * j) % 15] * (j % 3)) + "the"[:j % 4] + ("", ",", "...", "\u0307")[j % 4]
                      for j in range(30)) for i in range(40)] + ["\u0130! x\u0130?! x\u0130", "a" * 100, ""]
    model = packing.WordTokenizer(packing.tokenizer_path())
    for at in range(0, len(texts), 10):
        want = [np.array(model.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[at:at + 10]]
        assert list(model.encode([t.encode() for t in texts[at:at + 10]])) == want


def test_counting_holds_a_part_of_a_bucket(monkeypatch):
    """A reducer's sorting does not hold all of its bucket's hashes several times over."""
    import tracemalloc
    from collections import defaultdict
    from cohortlab.llm import chunks, jaccard
    monkeypatch.setattr(jaccard, "COUNTED", 1 << 14, raising=False)
    rng = np.random.default_rng(3)
    hashes = [np.unique(rng.integers(0, 1 << 20, 20_000, dtype=np.uint64)) + np.uint64(1 << 40) for _ in range(40)]
    counts = [rng.integers(1, 3000, len(h)).astype("<u4") for h in hashes]
    heads = [chunks.pack_sorted(h) for h in hashes]
    messages = [len(x).to_bytes(8, "little") + x + chunks.pack(c.tobytes()) for x, c in zip(heads, counts)]
    want = defaultdict(int)
    for h, c in zip(hashes, counts):
        for x, k in zip(h.tolist(), c.tolist()):
            want[x] += k
    tracemalloc.start()
    out = jaccard._sum_counts(messages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [np.frombuffer(chunks.unpack(x), "<u2").tolist() for x in out] == [[min(want[x], 65535) for x in h.tolist()] for h in hashes]
    assert peak < 3 * sum(h.nbytes for h in hashes)
    one = jaccard._sum_counts(messages[:1])
    assert np.frombuffer(chunks.unpack(one[0]), "<u2").tolist() == counts[0].tolist()


def test_worker_holds_the_caches_of_one_operator():
    from cohortlab.llm import caches
    held = [1]
    caches.enter("one", held.clear)
    caches.enter("one", held.clear)
    assert held
    caches.enter("two")
    assert not held
